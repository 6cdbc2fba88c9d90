"""op7 against all pairs."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from pagegraph.llm import common, components, jaccard


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    """(doc_id, n, component) of every row, by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def family(rng, words, base, n, rate):
    return [" ".join(rng.choice(words) if rng.random() < rate else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("width,percent,block,queries", [(4, 85, 256, 2048), (5, 80, 3, 2), (2, 50, 1, 1)])
def test_against_all_pairs(spark, width, percent, block, queries):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for size in (5, 30, 120):
        base = [rng.choice(words) for _ in range(size)]
        for rate in (0.0, 0.01, 0.03, 0.08):
            texts += family(rng, words, base, 6, rate)
    texts += [" ".join([*passage, *(rng.choice(words) for _ in range(20))]) for _ in range(25)]
    texts += [None, "", "  ", "w1", "W1", "w1 w2"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (4, texts[9])]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), width=width, percent=percent, block=block, queries=queries)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, width, percent)


def test_edge_cases(nasty, nothing):
    got = jaccard.similar(nasty).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in nasty.collect()], 4, 85)
    assert jaccard.similar(nothing).count() == 0


def test_query(spark, sf_dir, docs):
    got = jaccard.op7_token_group_join(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 85)


def test_keep_one(nasty, nothing):
    kept = jaccard.keep_one(nasty, width=5, percent=80)
    assert kept.columns == nasty.columns and kept.exceptAll(nasty).isEmpty()
    want = {i for i, n, c in brute([(r.doc_id, r.text) for r in nasty.collect()], 5, 80) if n and i is not None and i == c}
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None and (r.text or "").strip(" \n\t")) == sorted(want)
    assert sum(r.doc_id is None for r in rows) == 2
    assert jaccard.keep_one(nothing).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{i: 100 for i in range(101, 140)}, 300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_all_texts_of_a_repeated_doc_id_link(spark):
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "abcd"]
    rows = [(50, t) for t in texts] + [(10 * k + 10, t) for k, t in enumerate(texts)]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {10}


def test_texts_that_stay_are_not_moved(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(160):040x}" for _ in range(200)) for _ in range(400)]
    rows = list(enumerate([*texts, *texts[:5]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sc = spark.sparkContext._jsc.sc()

    def moved():
        sc.listenerBus().waitUntilEmpty()
        return sum(sc.statusStore().executorList(True).apply(i).totalShuffleWrite() for i in range(sc.statusStore().executorList(True).size()))

    docs = common.stored(docs)
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        kept = common.stored(jaccard.keep_one(docs, width=5, percent=80))
        assert moved() - before < sum(map(len, texts)) / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400))


def test_packed_sketch():
    size, rng = (1 << jaccard.SKETCH_BITS) // jaccard.CHUNKS, np.random.default_rng(1)
    sparse = (rng.random(size) < 0.2).astype(np.uint32)
    for counts in (np.zeros(size, np.uint32), np.full(size, 2**32 - 1, np.uint32), sparse, sparse * rng.integers(1, 1 << 32, size, np.uint32)):
        assert np.array_equal(jaccard.unpacked(jaccard.packed(counts)), counts)
    assert len(jaccard.packed(sparse)) < 0.7 * len(zlib.compress(sparse.tobytes(), 1))


def test_a_full_bit_map_loses_no_row(spark):
    rows = [(i, f"t{i}") for i in range(50)] + [(None, "x"), (7, "again")]
    df, ids = spark.createDataFrame(rows, "doc_id long, _w string"), spark.range(0, 50, 7).toDF("doc_id")
    for bits in (32, 1 << 23):
        told = [(tuple(r.row), r.maybe) for r in common.marked(df, ids, "doc_id", bits=bits).collect()]
        assert sorted((r for r, _ in told), key=str) == sorted(rows, key=str)
        assert all(maybe for (i, _), maybe in told if i is not None and i % 7 == 0)
    sure, open_ = common.parted(df, ids, "doc_id")
    assert sorted((tuple(r) for r in sure.unionByName(open_).collect()), key=str) == sorted(rows, key=str)
