"""A link graph as two tables, nodes and edges, and the lookups over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ingest import packed


@dataclass(frozen=True)
class Graph:
    """``nodes(id, title, is_redirect)`` and ``edges(src, dst)``; titles compare by their UTF-8 bytes.

    ``edges_in`` may hold the same edges again in the order of ``dst``, for searches against
    their direction.
    """

    nodes: DataFrame
    edges: DataFrame
    edges_in: DataFrame | None = None

    @property
    def incoming(self) -> DataFrame:
        return self.edges if self.edges_in is None else self.edges_in

    # titles
    def by_title(self, title: str) -> DataFrame:
        return self.nodes.where(F.col("title") == title)

    def has_title(self, title: str) -> bool:
        return not self.by_title(title).isEmpty()

    def titles_of(self, ids: DataFrame) -> DataFrame:
        """``ids(id)`` with their titles and flags, null for ids that no node has."""
        return ids.join(self.nodes, "id", "left")

    def prefix(self, prefix: str, n: int = 10) -> DataFrame:
        """The first ``n`` titles that begin with ``prefix``; nothing in it is a wildcard."""
        return self.nodes.where(F.col("title").startswith(prefix)).select("title").orderBy("title").limit(max(n, 0))

    def random_title(self, seed: int | None = None) -> str | None:
        row = self.nodes.select("title", F.rand(seed).alias("r")).agg(F.min_by("title", "r").alias("title")).first()
        return row.title

    def by_order(self, column: str) -> DataFrame:
        return self.nodes.orderBy(column)

    # neighbours and degrees
    def out_neighbors(self, ids: DataFrame) -> DataFrame:
        return ids.select(F.col("id").alias("src")).join(self.edges, "src").select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))

    def in_neighbors(self, ids: DataFrame) -> DataFrame:
        return ids.select(F.col("id").alias("dst")).join(self.incoming, "dst").select(F.col("dst").alias("id"), F.col("src").alias("neighbor"))

    def reversed(self) -> Graph:
        turned = lambda edges: edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return Graph(self.nodes, turned(self.incoming), turned(self.edges))

    def out_degrees(self) -> DataFrame:
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def _degrees(self, end: str) -> DataFrame:
        counted = (self.edges if end == "src" else self.incoming).groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))
        return self.nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def csr_offsets(self, *, bucket_size: int = 65_536) -> DataFrame:
        """(id, degree, start): where each node's links begin when they are laid out in id order."""
        degrees = self.out_degrees().withColumn("bucket", F.expr(f"cast(floor(id / {bucket_size}) as bigint)"))
        sizes = degrees.groupBy("bucket").agg(F.sum("degree").alias("n"))
        sizes = sizes.select("bucket", F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a short row a bucket
        inside = F.coalesce(F.sum("degree").over(W.partitionBy("bucket").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return degrees.withColumn("inside", inside).join(sizes, "bucket").select("id", "degree", (F.col("before") + F.col("inside")).alias("start"))

    def counts(self) -> DataFrame:
        """One row: nodes and edges."""
        zero = F.lit(0).cast("long")
        parts = self.nodes.agg(F.count("*").alias("nodes")).select("nodes", zero.alias("edges")).unionByName(self.edges.agg(F.count("*").alias("edges")).select(zero.alias("nodes"), "edges"))
        return parts.agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))

    def dangling(self) -> DataFrame:
        """Edges whose source or target is no node."""
        ids = self.nodes.select("id")
        return self.edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst").unionByName(self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst")).distinct()

    def pages(self) -> DataFrame:
        """Packed pages (id, title, is_redirect, links)."""
        return packed(self.nodes, self.edges)


def series_statistics(values: DataFrame, column: str) -> DataFrame:
    """n, minimum, maximum, mean, sample deviation (0 for fewer than two) and sum of a column."""
    c = F.col(column)
    return values.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("stddev"), F.sum(c).alias("sum"))
