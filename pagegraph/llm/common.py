"""Helpers shared by the operators: reading, cutting lineage, hashing, partition plans."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpoint, discard, folder, stored, visible


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test-data layout, by any path that Spark can read."""
    visible(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bit_map(ids: DataFrame, *columns: str, bits: int) -> DataFrame:
    """(_w, _b): the words of a bit map of the ``columns`` of ``ids``, at most ``bits / 32`` short rows however large ``ids`` is."""
    place = F.pmod(F.xxhash64(*columns), F.lit(bits)).cast("int")
    return ids.select(place.alias("_p")).selectExpr("cast(div(_p, 32) as int) as _w", "shiftleft(1L, _p % 32) as _b").groupBy("_w").agg(F.bit_or("_b").alias("_b"))


def members_of(df: DataFrame, ids: DataFrame, *columns: str, bits: int = 1 << 23) -> DataFrame:
    """The rows of ``df`` whose ``columns`` may occur together in ``ids``: all that do, and a few others.

    A bit map of ``bits`` bits is broadcast, so at most ``bits / 32`` short rows however
    large ``ids`` is; it spares most rows the exact join that follows.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(bits)).cast("int")
    marked = df.withColumn("_p", place).withColumn("_w", F.expr("cast(div(_p, 32) as int)"))
    return marked.join(F.broadcast(_bit_map(ids, *columns, bits=bits)), "_w").where("shiftright(_b, _p % 32) & 1 = 1").drop("_w", "_b", "_p")


def marked(df: DataFrame, ids: DataFrame, column: str, bits: int = 1 << 23) -> DataFrame:
    """``row``, a struct of ``df``'s columns, and ``maybe``: false only where ``column`` isn't in ``ids``, by the bit map of ``members_of``; no row is moved."""
    place = F.pmod(F.xxhash64(column), F.lit(bits)).cast("int")
    rows = df.select(F.struct(*df.columns).alias("row"), place.alias("_p")).withColumn("_w", F.expr("cast(div(_p, 32) as int)"))
    told = rows.join(F.broadcast(_bit_map(ids, column, bits=bits)), "_w", "left")
    return told.select("row", F.expr("coalesce(shiftright(_b, _p % 32) & 1 = 1, false)").alias("maybe"))


def parted(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``column`` isn't in ``ids``, and those for which an exact join must tell; ``df`` is scanned for each."""
    told = marked(df, ids, column)
    return told.where("not maybe").select("row.*"), told.where("maybe").select("row.*")


def fold(value: object) -> int:
    """crc32 of an id's decimal text modulo 5, which deals documents into train and held-out folds.

    A null id counts as the empty text.
    """
    return zlib.crc32(b"" if value is None else str(value).encode()) % 5


def fold_column(name: str = "doc_id"):
    """``fold`` as a Spark column."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(5))


__all__ = ["checkpoint", "discard", "fold", "fold_column", "folder", "marked", "members_of", "parted", "slices", "stored", "table", "visible"]


def slices(column, size: int):
    """Python values of an Arrow column, ``size`` rows at a time, so that few long texts are alive at once."""
    for start in range(0, len(column), size):
        yield start, column.slice(start, size).to_pylist()
