"""op8 against all pairs of lines, and its oracle."""

import random

import duckdb

from pagegraph.llm import lines


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, edit_from=8):
    """{(row, line number)} of dropped lines, by comparing each line with all earlier ones."""
    last = 2**63 - 1
    all_lines = []
    for k, (i, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n") if text is not None else ()):
            words = line.translate(str.maketrans("\t\x0b\f\r", "    ")).split(" ")
            words = tuple(w for w in words if w)
            if words:
                all_lines.append(((last if i is None else i, n), k, words))
    gone = set()
    for at, k, words in all_lines:
        near = lambda w: w == words or min(len(w), len(words)) >= edit_from and distance_one(words, w)
        if any(other < at and near(w) for other, _, w in all_lines):
            gone.add(at)
    return gone


def cases():
    rng = random.Random(6)
    words = [f"v{i}" for i in range(40)]
    lines_ = [[rng.choice(words) for _ in range(rng.randint(5, 14))] for _ in range(25)]
    out = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(lines_))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(line))
                line[p : p + 1] = rng.choice([[], [rng.choice(words)], [line[p], rng.choice(words)]])
            text.append(rng.choice(["", " "]) + rng.choice([" ", "  ", "\t"]).join(line))
        out.append((i, "\n".join(text)))
    same = ["repeat " * n for n in (8, 9, 10, 12)]
    template = [f"page {i} of the same long template line here" for i in range(30)]
    return [*out, (70, "\n".join(same)), *((100 + i, t) for i, t in enumerate(template)), (5, out[5][1]), (None, out[3][1]), (80, None), (81, ""), (82, "\n\n")]


def test_against_all_pairs(spark):
    rows = cases()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in lines.dropped_lines(frame).collect()]
    assert set(got) == brute(rows)


def test_short_lines_that_repeat(spark):
    rows = [*cases(), (200, "MIT License\n\n v1  v2\tv3\nv4"), (201, "v1 v2 v3\nMIT  License\nMIT Licence\nv1 v2 v3 v5\n \nv4")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in lines.dropped_lines(frame).collect()}
    assert got == brute(rows) and {(201, 0), (201, 1), (201, 5)} <= got and not {(200, 0), (201, 2), (201, 3), (201, 4)} & got
    got = {tuple(r) for r in lines.dropped_lines(frame, edit_from=3).collect()}
    assert got == brute(rows, 3) and (201, 3) in got


def rebuilt(rows):
    gone, out = brute(rows), []
    for i, text in rows:
        key = 2**63 - 1 if i is None else i
        own = [] if text is None else text.split("\n")
        kept = [x for n, x in enumerate(own) if (key, n) not in gone]
        out.append((i, len(own), len(own) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_rows_are_rebuilt(spark, nasty, nothing):
    for frame in (spark.createDataFrame(cases(), "doc_id long, text string"), nasty):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        got = lines.dedup(frame).select("row.doc_id", "n_lines", "n_dropped", "text").collect()
        assert sorted(map(tuple, got), key=str) == rebuilt(rows)
    assert lines.dedup(nothing).count() == 0
    left = lines.without_repeats(nasty)
    assert left.columns == nasty.columns and left.schema.simpleString() == nasty.schema.simpleString()
    assert left.where("text = '' and n_chars > 0").isEmpty()
    want = [r for r in rebuilt([(r.doc_id, r.text) for r in nasty.collect()]) if r[2] == 0 or (r[3] or "").strip(" ")]
    assert left.count() == len(want)


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = lines.op8_line_dedup(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(lines.ORACLE).select(*got.columns).fetchall())


def test_native_plan(spark, sf_dir):
    plan = lines.op8_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
