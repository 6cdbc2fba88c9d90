"""Wiki XML dumps, plain or bzip2, and the index of multistream dumps.

A dump is read as text records that end with ``</page>``, which Spark splits across tasks
for plain and for bzip2 files alike, and each record is parsed as XML.  The index isn't
needed for that; it is parsed for tools that seek in the file, and a bad one is only
worth a warning.
"""

from __future__ import annotations

import logging
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

PAGE = "title string, ns int, id bigint, revision struct<id:bigint, text:string>"
#: Fixed value: how a bzip2 stream begins, with the magic number of its first block.
STREAM_START = re.compile(rb"BZh[1-9]1AY&SY")


def xml_dump(spark: SparkSession, path: str, *, index: str = "auto") -> DataFrame:
    """(page_no, ns, title, text) of every page, numbered in file order.

    ``index``: "auto" looks for the sidecar file, "none" doesn't, anything else is its path.
    """
    if index != "none" and path.endswith(".bz2"):
        check_index(spark, path, sidecar_index(path) if index == "auto" else index, asked=index != "auto")
    lines = spark.read.option("lineSep", "</page>").text(path)
    start = F.locate("<page>", "value")
    pages = lines.select("value", "_metadata.file_path", "_metadata.file_block_start").where(start > 0)
    # a task numbers its rows without a gap, a split's rows one after another
    pages = pages.withColumn("at", F.monotonically_increasing_id())
    split = ["file_path", "file_block_start"]
    sizes = pages.groupBy(*split).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    sizes = sizes.select(*split, "first", F.coalesce(F.sum("n").over(W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # a row of some 100 bytes for each split of the input, so broadcast: no text is moved
    pages = pages.join(F.broadcast(sizes), split)
    page = F.from_xml(F.concat(F.col("value").substr(start, F.length("value")), F.lit("</page>")), PAGE, {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"})
    pages = pages.select((F.col("before") + F.col("at") - F.col("first")).alias("page_no"), page.alias("page"))
    return pages.select("page_no", "page.ns", "page.title", F.coalesce("page.revision.text", F.lit("")).alias("text"))


def sidecar_index(path: str) -> str:
    """Where the index of a multistream dump lies by convention."""
    for end in (".xml.bz2", ".bz2"):
        if path.endswith(end):
            return path[: -len(end)] + "-index.txt.bz2"
    return path + "-index.txt.bz2"


def check_index(spark: SparkSession, path: str, index: str, *, asked: bool) -> DataFrame | None:
    """The ranges of an index, or None, with a warning, if it can't be used."""
    try:
        size = spark.read.format("binaryFile").load(path).select("length").first()[0]
        return index_ranges(read_index(spark, index), size)
    except Exception as error:  # whatever is wrong with it, the dump is read without
        (log.warning if asked else log.info)("index %s not used: %s", index, error)
        return None


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of an index file; line numbers ascend but have gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def index_ranges(lines: DataFrame, size: int) -> DataFrame:
    """Half-open byte ranges (start, stop) of ``offset:...`` lines over a file of ``size`` bytes.

    Blank lines are skipped and equal neighbours are one; offsets must be numbers within
    the file and may not fall, else ValueError.  The first range starts at 0 and the last
    ends with the file; an index without lines has no ranges.
    """
    lines = lines.where(F.trim("value") != "")
    offsets = lines.select("line_no", F.when(F.locate(":", "value") > 1, F.expr("try_cast(substring_index(value, ':', 1) as bigint)")).alias("offset"))
    bad = offsets.where(F.col("offset").isNull() | (F.col("offset") < 0) | (F.col("offset") >= size))
    # within a slice of line numbers by comparison with the line before, between slices by their bounds
    sliced = offsets.withColumn("slice", F.shiftright("line_no", 16))
    fell = sliced.withColumn("last", F.lag("offset").over(W.partitionBy("slice").orderBy("line_no"))).where("offset < last")
    bounds = sliced.groupBy("slice").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    crossed = bounds.withColumn("last", F.max("high").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1))).where("low < last")  # a row a slice
    for what, wrong in (("an offset is missing, malformed or outside the file", bad), ("offsets fall", fell), ("offsets fall", crossed)):
        if not wrong.isEmpty():
            raise ValueError(what)
    starts = offsets.select(F.col("offset").alias("start")).distinct()
    if not starts.isEmpty():
        starts = starts.unionByName(lines.sparkSession.createDataFrame([(0,)], "start bigint")).distinct()
    ranges = starts.withColumn("bucket", F.shiftright("start", 32))
    following = ranges.groupBy("bucket").agg(F.min("start").alias("low")).withColumn("following", F.lead("low").over(W.orderBy("bucket"))).select("bucket", "following")  # a row for each 4 GiB
    inside = F.lead("start").over(W.partitionBy("bucket").orderBy("start"))
    return ranges.withColumn("stop", inside).join(following, "bucket").select("start", F.coalesce("stop", "following", F.lit(size)).cast("bigint").alias("stop"))


def stream_starts(content: bytes) -> list[tuple[int, int]]:
    """Half-open ranges of the bzip2 streams in ``content``; bytes before the first belong to none."""
    at = [m.start() for m in STREAM_START.finditer(content)]
    return list(zip(at, [*at[1:], len(content)]))


def streams_of(files: DataFrame) -> DataFrame:
    """(path, start, stop) of the bzip2 streams in ``files(path, content)``, found by their magic numbers."""

    def run(frames):
        for frame in frames:
            rows = [(p, a, b) for p, content in zip(frame["path"], frame["content"]) for a, b in stream_starts(content)]
            yield pd.DataFrame(rows, columns=["path", "start", "stop"])

    return files.select("path", "content").mapInPandas(run, "path string, start long, stop long")


def bz2_streams(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, stop) of the streams in bzip2 files; a task reads one file, of 2 GiB at most."""
    return streams_of(spark.read.format("binaryFile").load(path))
