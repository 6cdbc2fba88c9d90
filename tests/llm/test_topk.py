"""op1 against brute force."""

import math
import random

import duckdb
import pytest

from pagegraph.llm import topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int"


def brute(rows, queries, k, scale=256):
    vectors = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for q in sorted(set(queries) & {i for i, _ in vectors}):
        scored = sorted((-clip(sum(a * b for a, b in zip(own, v))), i) for j, own in vectors if j == q for i, v in vectors if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("blocks", [(4, 7), (1000, 1000)])
def test_against_brute_force(spark, blocks):
    rng = random.Random(2)
    vector = lambda: [rng.choice([0.0, 0.0, rng.uniform(-1, 1), 0.5]) for _ in range(8)]
    rows = [(i, vector()) for i in range(60)]
    same = vector()
    rows += [(100 + i, same) for i in range(30)]  # ties
    rows += [(5, rows[5][1]), (6, vector()), (None, vector()), (200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf"), 1.0]), (204, []), (205, [3.0] * 4)]
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA).repartition(5)
    got = topk.search(frame, frame.where("vec_id % 3 = 0"), query_block=blocks[0], candidate_block=blocks[1]).collect()
    assert sorted(map(tuple, got)) == brute(rows, [i for i, _ in rows if i is not None and i % 3 == 0], 5)


def test_repeated_ids_against_the_oracle(spark):
    rng = random.Random(5)
    rows = [(i // 2, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)] + [(50, [0.5] * 4)] * 3
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)
    con, embeddings = duckdb.connect(), frame.select("vec_id", "embedding").toArrow()  # noqa: F841  read by name
    got = topk.search(frame, frame.where("vec_id % 50 = 0"), candidate_block=7)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(topk.ORACLE).select(*got.columns).fetchall())


def test_huge_weights_and_few_rows(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [1e9, 1e9])]
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, topk.search(frame, frame).collect())) == brute([(i, [float(x) for x in map(lambda y: __import__("numpy").float32(y), v)]) for i, v in rows], [0, 1, 2], 5)
    assert topk.search(frame.limit(1), frame.limit(1)).count() == 0
    assert topk.search(frame.limit(0), frame.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, topk.op1_term_topk(spark, sf_dir).select("query_id", "rank", "vec_id", F.col("score")).collect())) == brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
