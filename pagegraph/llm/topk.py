"""Exact top-k search by exhaustive term-at-a-time accumulation.

A component of a vector is a term, its quantised value floor(256 x) the weight.  Queries
and candidates are cut into blocks of stated sizes; a task gets one query block and one
candidate block, builds the candidates' postings term by term, lets each query scatter
its weighted postings into a dense score array, and selects the block's best by
partition.  The blocks' winners are merged by a ranking over at most k rows a block.

Edge cases: vectors that are null or hold a null or non-finite component take no part,
nor do rows without a vec_id; a shorter vector lacks its further terms, which weigh 0;
an empty vector scores 0 with everything; rows that repeat a vec_id are candidates each,
and a query row isn't matched with any row of its own vec_id; query rows that repeat a
vec_id are one query, whose best pairs of all its rows are ranked together; equal scores
go to smaller vec_ids; scores beyond 64 bits are held at the limits, and ranked so; other
columns, names like ``score`` included, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
EDGE = 2**62


def weights(table: pa.Table, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ascending vec_ids and their quantised vectors (float64, whole numbers)."""
    ids, column = table.column("vec_id").to_numpy().astype(np.int64), table.column("embedding").combine_chunks()
    flat, ends = np.floor(scale * np.asarray(column.flatten(), dtype=np.float64)), np.cumsum([0, *pc.list_value_length(column).to_pylist()])
    order = np.argsort(ids, kind="stable")
    return ids[order], [flat[ends[i] : ends[i + 1]] for i in order]


def matrix(vectors: list[np.ndarray], width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = [int(x) for x in v] if kind is object else v
    return out


def best(q_ids, q_vectors, c_ids, c_vectors, k: int, step: int = 32):
    """Arrays of query_id, vec_id and score of the ``k`` best candidates of each query row, ties to smaller vec_ids; ids ascend."""
    if not len(q_ids) or not len(c_ids):
        return
    width = max(map(len, [*q_vectors, *c_vectors]))
    top = lambda vs: max((float(np.abs(v).max()) for v in vs if len(v)), default=0.0)
    bound, n = top(q_vectors) * top(c_vectors) * max(width, 1), len(c_ids)
    kind = np.int32 if bound < 2**31 else np.int64 if bound * n < EDGE else object
    q, c = matrix(q_vectors, width, kind), matrix(c_vectors, width, kind)
    postings = [(at, c[at, t]) for t in range(width) if len(at := np.flatnonzero(c[:, t]))] if width else []
    terms = [t for t in range(width) if c[:, t].any()]
    place = np.arange(n - 1, -1, -1)
    for start in range(0, len(q_ids), step):
        part = q[start : start + step]
        score = np.zeros((len(part), n), dtype=kind)
        for t, (at, weight) in zip(terms, postings):
            rows = np.flatnonzero(part[:, t])
            if len(at) == n and len(rows) == len(part):
                score += part[:, t, None] * weight
            elif len(rows):
                score[np.ix_(rows, at)] += part[rows, t, None] * weight
        if kind is object:
            score = np.array([[max(-(2**63), min(2**63 - 1, x)) for x in row] for row in score], dtype=object).reshape(score.shape)
        key = score.astype(object if kind is object else np.int64) * n + place  # distinct in a row, in the order wanted
        ids = q_ids[start : start + step]
        for i, (low, high) in enumerate(zip(np.searchsorted(c_ids, ids), np.searchsorted(c_ids, ids, "right"))):
            key[i, low:high] = -(2**80) if kind is object else np.iinfo(np.int64).min
        found = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), key.shape)
        found = np.take_along_axis(found, np.argsort(-np.take_along_axis(key, found, 1) if kind is object else ~np.take_along_axis(key, found, 1), axis=1), 1)
        rows = np.repeat(np.arange(len(ids)), found.shape[1])
        found = found.ravel()
        good = c_ids[found] != ids[rows]
        yield ids[rows[good]], c_ids[found[good]], score[rows[good], found[good]]


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: int = 256, query_block: int = 16_384, candidate_block: int = 2_048) -> DataFrame:
    """The ``k`` best candidates of ``vectors(vec_id, embedding)`` for each row of ``queries``, its own vec_id aside."""
    common.visible(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)

    def blocks(df: DataFrame, size: int) -> int:
        return max(1, -(-df.count() // size))

    q_blocks, c_blocks = blocks(queries, query_block), blocks(vectors, candidate_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = usable(queries).select("*", mine(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    c = usable(vectors).select("*", mine(c_blocks).alias("cb"), every(q_blocks).alias("qb"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        steps = [*best(*weights(left, scale), *weights(right, scale), k)]
        return pa.Table.from_arrays([pa.array(np.concatenate(x).astype(np.int64) if steps else [], pa.int64()) for x in (zip(*steps) if steps else ((), (), ()))], schema=OUT)

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_term_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
