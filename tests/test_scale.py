"""What grows with the tables: where whole files, texts and numbers of rows may be held or moved."""

import random

import pytest

from pagegraph.operators.graph import Graph
from pagegraph.operators.ranking import dense_index
from pagegraph.plans.queries import QUERIES
from pagegraph.sources import legacy, store


def nodes(plan):
    """A logical plan's nodes, each as (name, names of its output columns)."""
    yield plan.nodeName(), {plan.output().apply(i).name() for i in range(plan.output().size())}
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_no_file_is_held_for_every_stream(spark, sf_dir):
    """a window or a row queue of Python functions over ranges joined with their files holds a file for every stream."""
    found = [columns for name, columns in nodes(QUERIES["bz2_streams"](spark, sf_dir)._jdf.queryExecution().optimizedPlan()) if name == "Window" or "EvalPython" in name]
    assert found and not any("content" in columns for columns in found)


def test_rows_are_numbered_where_they_are(spark):
    """F4 to F10: no task may hold all rows whose keys are near each other, with their texts."""
    rows = spark.range(0, 3_000, 1, 8).selectExpr("cast(id * (id + 1) div 2 as long) - 40000 as k", "repeat('x', 50) as text")
    for most_words in (1 << 20, 0):
        out = dense_index(rows, "k", "i", most_words=most_words)
        assert [(r.k, r.i) for r in out.orderBy("k").collect()] == [(i * (i + 1) // 2 - 40_000, i) for i in range(3_000)]
        assert not any(name in ("Window", "Aggregate") and "text" in columns for name, columns in nodes(out._jdf.queryExecution().optimizedPlan()))
    assert "Exchange hashpartitioning" not in str([line for line in dense_index(rows, "k", "i")._jdf.queryExecution().executedPlan().toString().splitlines() if "text#" in line])


@pytest.mark.parametrize("kind", ["buffer", "segment"])
def test_legacy_files_are_written_and_read_by_ranges(spark, tmp_path, monkeypatch, kind):
    """neither the driver nor one task may hold the file; the bytes are those of the whole-file writers."""
    rng = random.Random(7)
    nodes = [(3 * i, f"ż{rng.randrange(10**6)} {i}", i % 5 == 0) for i in range(1, 700)]
    edges = sorted({(3 * rng.randrange(1, 700), 3 * rng.randrange(1, 700)) for _ in range(4_000)})
    graph = Graph(spark.createDataFrame(nodes, "id long, title string, is_redirect boolean").repartition(5), spark.createDataFrame(edges, "src long, dst long").repartition(5))
    monkeypatch.setattr(legacy, "CHUNK_ROWS", 50)
    path = str(tmp_path / "g")
    store.save(graph, path, kind)
    links = {i: [b for a, b in edges if a == i] for i, *_ in nodes}
    data = (tmp_path / "g").read_bytes()
    parse = {"buffer": legacy.parse_buffer, "segment": legacy.parse_segment}[kind]
    order = sorted(nodes, key=lambda n: n[1].encode() if kind == "buffer" else n[0])
    assert list(parse(data)) == [(i, t, r, links[i]) for i, t, r in order]
    if kind == "segment":
        n, m, section = legacy._segment_header(data, len(data))
        cut = lambda name, dtype: legacy.np.frombuffer(data[section[name][0] : sum(section[name])], dtype).tolist()
        assert cut("in", "<i4") == [a for _, a in sorted((b, a) for a, b in edges)]
        assert cut("ids", legacy.SEGMENT_ID) == [(i, k) for k, (i, *_) in enumerate(order)]
        keys, named = data[section["name_keys"][0] : sum(section["name_keys"])], sorted(nodes, key=lambda n: n[1].encode())
        assert [(keys[k : k + size].decode(), i) for k, size, i in cut("names", legacy.SEGMENT_NAME)] == [(t, i) for i, t, _ in named]
        table = legacy.np.frombuffer(data, legacy.SEGMENT_NODE, n, section["nodes"][0])
        assert table["in_degree"].tolist() == [sum(b == i for _, b in edges) for i, *_ in order] and table["in"].tolist() == [sum(b < i for _, b in edges) for i, *_ in order]
    ranges, pages_of = {"buffer": legacy.split_buffer, "segment": legacy.split_segment}[kind](path, 400)
    assert len(ranges) > 1
    with open(path, "rb") as f:
        assert [p for a, b, n in ranges for p in pages_of(f, a, b, n)] == list(parse(data))
    read = {"buffer": legacy.read_buffer, "segment": legacy.read_segment}[kind](spark, f"file:{path}")
    assert sorted((r.id, r.title, r.is_redirect, r.links) for r in read.collect()) == sorted(parse(data))
