"""Dump rows that arrive as a stream.

Parsing keeps no state, so the same expressions serve; titles, redirects and edges need
the whole dump and are built in batch from what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import parse


def parsed_pages(dump: DataFrame, namespace: int = 0) -> DataFrame:
    """Parsed pages (id, title, is_redirect, target, link_titles) of a streaming dump; ids are the stream's page numbers."""
    return parse(dump.where(F.col("ns") == namespace).select(F.col("page_no").alias("id"), "title", F.coalesce("text", F.lit("")).alias("text")))
