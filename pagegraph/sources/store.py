"""Graphs on disk: Parquet, and the registry of formats."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import stored
from ..operators import ingest
from ..operators.graph import Graph
from . import dump, legacy


def graph_of(pages: DataFrame, **cleanup) -> Graph:
    """The packed graph of dump rows (page_no, ns, title, text)."""
    parsed = stored(ingest.numbered(ingest.parse(ingest.main_rows(pages))))
    live = stored(ingest.clean(ingest.last_wins(parsed), ingest.title_universe(parsed), **cleanup))
    return Graph(ingest.nodes_of(live), ingest.edges_of(live))


def out_order(edges: DataFrame) -> DataFrame:
    return edges.repartitionByRange("src").sortWithinPartitions("src", "dst")


def in_order(edges: DataFrame) -> DataFrame:
    return edges.repartitionByRange("dst").sortWithinPartitions("dst", "src")


#: The folder that is written last: a graph without it isn't whole.
WHOLE = "whole"


def save_parquet(graph: Graph, path: str) -> None:
    """Nodes sorted by title and edges by either end, so that lookups skip row groups; refuses to overwrite."""
    check(graph)
    graph.nodes.sort("title").write.mode("errorifexists").parquet(f"{path}/nodes")
    out_order(graph.edges).write.mode("errorifexists").parquet(f"{path}/edges_out")
    in_order(graph.edges).write.mode("errorifexists").parquet(f"{path}/edges_in")
    graph.nodes.sparkSession.range(1).coalesce(1).write.mode("errorifexists").parquet(f"{path}/{WHOLE}")


def load_parquet(spark: SparkSession, path: str) -> Graph:
    """The graph under ``path``; ValueError if its writer didn't come to the end."""
    try:
        spark.read.parquet(f"{path}/{WHOLE}")
    except AnalysisException as error:
        raise ValueError(f"{path} holds no whole graph") from error
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges_out"), spark.read.parquet(f"{path}/edges_in"))


def check(graph: Graph) -> None:
    """ValueError if an edge leads to or from an id that no node has."""
    wrong = graph.dangling().first()
    if wrong is not None:
        raise ValueError(f"edge {wrong.src} -> {wrong.dst} has an end that is no node")


def load(spark: SparkSession, path: str, kind: str, *, index: str = "auto") -> Graph:
    """A graph from a file of any readable format, by name in any case."""
    readers = {
        "xml": lambda: graph_of(dump.xml_dump(spark, path, index=index)),
        "parquet": lambda: load_parquet(spark, path),
        "buffer": lambda: legacy.unpack(legacy.read_buffer(spark, path)),
        "segment": lambda: legacy.unpack(legacy.read_segment(spark, path)),
    }
    if kind.lower() not in readers:
        raise ValueError(f"unknown input format {kind!r}; known are {', '.join(readers)}")
    return readers[kind.lower()]()


def unpacked(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a binary file."""
    graph = load(spark, path, kind)
    return graph.nodes, graph.edges


def save(graph: Graph, path: str, kind: str) -> None:
    writers = {"parquet": save_parquet, "buffer": legacy.write_buffer, "segment": legacy.write_segment}
    if kind.lower() not in writers:
        raise ValueError(f"unknown output format {kind!r}; known are {', '.join(writers)}")
    writers[kind.lower()](graph, path)


def counts(graph: Graph) -> dict[str, int]:
    return graph.counts().select(F.col("nodes"), F.col("edges")).first().asDict()
