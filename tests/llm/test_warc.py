"""op2: WARC files written, read back and audited, against plain comparison."""

import gzip
import re
from collections import Counter
from pathlib import Path

import duckdb

from pagegraph.llm import warc
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, sha string, file string, idx int"


def pages(spark, extra=()):
    rows = [(i, f"u{i % 3}", f"body {i} é\r\n\r\nmore" if i % 7 else None) for i in range(900)]
    rows += [(5, "u", "again"), (5, "u", "again"), (6, "a\r\nb", "x" * 200_000), (None, None, None), (None, "n", "one"), (None, "n", "two"), *extra]
    return spark.createDataFrame([(*r, "s", "f", 1) for r in rows], SCHEMA)


def found(spark, folder, frame, replicas=None, **how):
    warc.write(warc.plan(frame, **how), str(folder), replicas)
    return warc.leaves(spark, str(folder))


def test_files_are_warc_and_come_back(spark, tmp_path):
    frame = pages(spark)
    leaves = found(spark, tmp_path / "a", frame, file_records=256).collect()
    want = sorted(((r.page_id, re.sub("\r\n", "%0D%0A", r.url or ""), warc.DATE, r.html or "") for r in frame.collect()), key=str)
    got = warc.parsed(spark, str(tmp_path / "a"))
    assert sorted((tuple(r)[2:] for r in got.collect()), key=str) == want
    files = {f.parent.name[5:]: gzip.decompress(f.read_bytes()) for f in Path(tmp_path / "a").glob("replica=mine/file=*/*.gz")}
    for name, data in files.items():  # read by Content-Length, as any reader of the format would
        at, records = 0, []
        while at < len(data):
            head = data[at : data.index(b"\r\n\r\n", at)].decode()
            assert head.startswith("WARC/1.1\r\n") and "\r\nWARC-Date: " in head
            end = at + len(head.encode()) + 4 + int(re.search(r"Content-Length: (\d+)", head)[1])
            assert data[end : end + 4] == b"\r\n\r\n"
            records.append((at, end + 4 - at, "resource" in head))
            at = end + 4
        base = records[0][1]
        assert [r[2] for r in records] == [False] + [True] * (len(records) - 1)
        own = sorted((r for r in leaves if r.file == name), key=lambda r: r.ord)
        assert [(r.start, r.length) for r in own] == [(a - base, n) for a, n, _ in records[1:]]


def test_audit_tells_exactly_the_damage(spark, tmp_path):
    frame = pages(spark, [(901, "u", "only mine"), (902, "u", "only other"), (100, "u", "copy"), (100, "u", "copy")])
    i, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    cases = F.when(i == 77, F.lit("rot")).when(i == 500, F.concat(html, F.lit(" longer"))).when(i == 302, F.lit("")).when(i == 901, F.lit(None)).when(i.isNull() & (html == "one"), F.lit("1ne")).otherwise(html)
    leaves = found(spark, tmp_path / "a", frame, {"mine": F.when(F.coalesce(i == 902, F.lit(False)), F.lit(None)).otherwise(html), "other": cases}, file_records=64)
    got = sorted((str(r.page_id), r.expected is not None, r.found is not None) for r in warc.audit(leaves).collect())
    assert got == sorted([("77", True, True), ("500", True, True), ("302", True, True), ("901", True, False), ("902", False, True), ("None", True, True)])
    # one copy of several is lost
    lost = found(spark, tmp_path / "b", frame, {"mine": html, "other": F.when((i == 100) & (F.col("url") == "u1"), F.lit(None)).otherwise(html)})
    assert [(r.page_id, r.found) for r in warc.audit(lost).collect()] == [(100, None)]


def test_records_that_change_places(spark, tmp_path):
    leaves = found(spark, tmp_path / "a", pages(spark), {"mine": F.col("html"), "other": F.col("html")})
    rows = leaves.where("replica = 'other' and page_id between 300 and 301").collect()
    (a, b), n = sorted(rows, key=lambda r: r.ord), leaves.count()
    swapped = leaves.where("not (replica = 'other' and coalesce(page_id, -1) between 300 and 301)").unionByName(spark.createDataFrame([{**b.asDict(), "ord": a.ord, "start": a.start}, {**a.asDict(), "ord": b.ord, "start": a.start + b.length}], leaves.schema))
    assert swapped.count() == n and warc.audit(swapped).count() == 0
    assert [(r.page_id, r.start) for r in warc.layout(swapped).collect()] == [(300, a.start)]
    assert warc.layout(leaves).count() == 0


def test_large_ranges_are_split(spark, tmp_path):
    frame = spark.createDataFrame([(None, f"u{i}", f"b{i}") for i in range(600)] + [(7, "u", f"b{i}") for i in range(300)], "page_id long, url string, html string")
    leaves = found(spark, tmp_path / "a", frame, file_records=50)
    assert max(Counter(r.file for r in leaves.collect()).values()) < 100
    assert leaves.count() == 900


def test_nothing(spark, tmp_path):
    leaves = found(spark, tmp_path / "a", pages(spark).limit(0))
    assert leaves.count() == warc.audit(leaves).count() == warc.layout(leaves).count() == 0


def test_oracle_and_native_plan(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = warc.op2_warc_merkle(spark, sf_dir)
    assert "Python" not in got._jdf.queryExecution().toString()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(con.sql(warc.ORACLE).select(*got.columns).fetchall(), key=key)
