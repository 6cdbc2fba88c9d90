"""Proportional stratified interleaving, with DataFrame functions only.

Within each source rows are ranked in a seeded shuffle; the fractional rank
(rank - 1/2) / rows of the source then orders all rows, so that any stretch of that
order holds the sources in their proportions.  The order is cut into shards whose
counts differ by one at most.

Both rankings are distributed.  A row number is the count of the rows in earlier
buckets, from a table of bucket sizes, plus the row number inside the bucket.  Buckets
of the shuffle split every source by the leading hex digits of the shuffle key, and
buckets of the interleaving split the fractional ranks evenly, so a source with a third
of all rows is spread over as many tasks as the rest.

Edge cases: a null source is a source of its own; a null text has no bytes; repeated
rows are dealt one by one; an empty table gives an empty result; a null doc_id is
shuffled as the empty id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


def _numbered(rows: DataFrame, group: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Adds ``name``, the row number from 1 within ``group`` by (bucket, order), and ``<name>_of``, the group's rows."""
    sizes = rows.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*group)).alias(f"{name}_of"))
    inside = rows.withColumn("_inside", F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order)))
    return inside.join(sizes, [*group, bucket]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def interleave(docs: DataFrame, *, shards: int = 8, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """Deals ``docs(doc_id, text, source)`` into ``shards``; returns doc_id, size, text_crc32, source, shard and slot."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.concat(F.lit("="), F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).alias("stratum"),
        "source",
        key.alias("shuffle"),
    )
    rows = rows.withColumn("part", F.substring("shuffle", 1, len(f"{buckets - 1:x}")))
    rows = _numbered(rows, ["stratum"], "part", ["shuffle", "doc_id", "size", "text_crc32"], "rank").drop("part")
    rows = rows.withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("rank_of")))
    rows = rows.withColumn("part", F.floor(F.col("fraction") * buckets)).withColumn("whole", F.lit(0))
    rows = _numbered(rows, ["whole"], "part", ["fraction", "stratum", "rank"], "place")
    rows = rows.withColumn("shard", F.expr(f"cast(div((place - 1) * {shards}, place_of) as int)"))
    start = F.expr(f"div(shard * place_of + {shards - 1}, {shards})")
    return rows.select("doc_id", "size", "text_crc32", "source", "shard", (F.col("place") - 1 - start).cast("long").alias("slot"))


def op10_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = interleave(common.table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
