"""op10 and the pipeline."""

import zlib
from collections import Counter

import corpus_pipeline
from pagegraph.llm import sharding
from tests.llm import test_jaccard, test_lines


def check(rows, frame, shards):
    docs = [(r.doc_id, r.text, r.source) for r in frame.select("doc_id", "text", "source").collect()]
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for i, t, s in docs), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.source) for r in rows), key=str) == want
    counts = Counter(r.shard for r in rows)
    assert all(0 <= s < shards for s in counts)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    by_source = Counter(r.source for r in rows)
    for (s, source), n in Counter((r.shard, r.source) for r in rows).items():
        assert abs(n - by_source[source] * counts[s] / len(rows)) <= 2  # the mixture, but for rounding


def test_interleaving(nasty, nothing, docs):
    check(sharding.interleave(docs).collect(), docs, 8)
    check(sharding.interleave(nasty, shards=3).collect(), nasty, 3)
    check(sharding.interleave(docs.limit(5), buckets=16).collect(), docs.limit(5), 8)
    assert sharding.interleave(nothing).count() == 0
    a, b = ({(r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs, seed=s).collect()} for s in (1, 2))
    assert a != b


def test_query(spark, sf_dir, docs):
    rows = sharding.op10_stratified_sharding(spark, sf_dir)
    assert rows.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert "Python" not in rows._jdf.queryExecution().toString()
    assert {(r.law, r.grown_shard) for r in rows.collect()} == {("rows", None)}


def test_stages_and_run(spark, sf_dir, docs, tmp_path):
    frame, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, sf_dir).write.parquet(str(tmp_path / name))
        before, frame = frame, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, frame)
    for name in list(seen)[:-1]:
        assert seen[name][1].columns == docs.columns
    before, after = seen["toxicity"]
    assert after.exceptAll(before).isEmpty() and 0.8 * before.count() < after.count() <= before.count()
    before, after = seen["line dedup"]
    want = {(i, t) for i, _, dropped, t in test_lines.rebuilt([(r.doc_id, r.text) for r in before.collect()]) if not dropped or t.strip(" ")}
    assert {(r.doc_id, r.text) for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["n-gram Jaccard join"]
    want = {i for i, n, c in test_jaccard.brute([(r.doc_id, r.text) for r in before.collect()], 5, 80) if i == c}
    assert {r.doc_id for r in after.collect()} == want and after.exceptAll(before).isEmpty()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, seen["best-fit packing"][1].collect()))


def test_stages_on_odd_rows_and_on_none(spark, sf_dir, nasty, nothing):
    pieces = {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    for frame in (nasty, nothing):
        rows = Counter(tuple(r) for r in frame.collect())
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            got = out.collect()
            if name == "best-fit packing":
                assert set(out.columns) == pieces and sum(r.piece == 0 for r in got) == sum(rows.values())
                continue
            assert out.columns == frame.columns and len(got) <= sum(rows.values())
            assert sum(r.text is None for r in got) == sum(n for r, n in rows.items() if r[1] is None)
            if name != "line dedup":
                assert not Counter(map(tuple, got)) - rows
