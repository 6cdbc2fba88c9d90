"""One query an operator.  Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import bz2
import functools
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from .. import lineage
from ..operators import ingest, paths
from ..operators.graph import Graph, series_statistics
from ..operators.ranking import positions
from ..sources import dump as dumps
from ..sources import store
from .views import views

QUERIES: dict = {}


def query(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lineage.visible(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _requests(spark: SparkSession, *pairs: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "query_id long, start string, end string")


# ingest
@query
def dump_main_pages(spark, sf_dir):
    return views(spark, sf_dir).pages.select("id", "title")


@query
def wikitext_links(spark, sf_dir):
    return ingest.page_links(views(spark, sf_dir).parsed)


@query
def wikitext_redirects(spark, sf_dir):
    return views(spark, sf_dir).parsed.where("is_redirect").select("id", "title", "target")


@query
def wikitext_capitalize(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", fn.capitalize(F.col("p_name")).alias("title"))


@query
def page_upsert_last_wins(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    return ingest.last_wins(pages).select("id", "title")


@query
def title_universe(spark, sf_dir):
    return views(spark, sf_dir).universe


@query
def red_links(spark, sf_dir):
    v = views(spark, sf_dir)
    return v.universe.join(v.latest, "title", "left_anti")


@query
def redirect_cleanup(spark, sf_dir):
    v = views(spark, sf_dir)
    return v.latest.select("id", "title").join(ingest.dropped_redirects(v.latest, v.universe), "id", "left_semi")


@query
def redirect_cleanup_by_hash(spark, sf_dir):
    """Cycles broken where the hash of the title is least, as pages in a hash table would be met."""
    v = views(spark, sf_dir)
    gone = ingest.dropped_redirects(v.latest, v.universe, ingest.java_hash_rank(F.col("title")))
    return v.latest.select("id", "title").join(gone, "id", "left_semi")


@query
def packed_pages(spark, sf_dir):
    return views(spark, sf_dir).graph.pages().select("id", "title", "is_redirect", F.size("links").alias("n_links"), F.array_join(F.col("links").cast("array<string>"), ",").alias("links"))


@query
def stats_before_cleanup(spark, sf_dir):
    v = views(spark, sf_dir)
    return ingest.statistics(v.latest, v.universe)


@query
def stats_after_cleanup(spark, sf_dir):
    v = views(spark, sf_dir)
    return ingest.statistics(v.live, v.universe)


@query
def avg_links(spark, sf_dir):
    return stats_after_cleanup(spark, sf_dir).select(F.round(F.try_divide("links", "articles"), 6).alias("avg_links"))


# adjacency
@query
def forward_edges(spark, sf_dir):
    return views(spark, sf_dir).graph.edges


@query
def reverse_edges(spark, sf_dir):
    return views(spark, sf_dir).graph.reversed().edges


@query
def out_neighbors(spark, sf_dir):
    graph = views(spark, sf_dir).graph
    return graph.out_neighbors(graph.nodes.select("id"))


@query
def in_neighbors(spark, sf_dir):
    graph = views(spark, sf_dir).graph
    return graph.in_neighbors(graph.nodes.select("id"))


@query
def out_degree(spark, sf_dir):
    return views(spark, sf_dir).graph.out_degrees()


@query
def in_degree(spark, sf_dir):
    return views(spark, sf_dir).graph.in_degrees()


@query
def csr_offsets(spark, sf_dir):
    return views(spark, sf_dir).graph.csr_offsets()


@query
def id_rank(spark, sf_dir):
    from ..operators.ranking import dense_index

    return dense_index(views(spark, sf_dir).graph.nodes.select("id"), "id", "rank")


@query
def graph_counts(spark, sf_dir):
    return views(spark, sf_dir).graph.counts()


@query
def dangling_edges(spark, sf_dir):
    """Over links by title before cleanup, so that some dangle."""
    v = views(spark, sf_dir)
    return Graph(v.graph.nodes, ingest.edges_of(v.latest)).dangling()


# lookups
@query
def title_lookup(spark, sf_dir):
    return views(spark, sf_dir).graph.by_title("NATION_15").select("id", "title", "is_redirect")


@query
def has_title(spark, sf_dir):
    graph = views(spark, sf_dir).graph
    return spark.createDataFrame([(t, graph.has_title(t)) for t in ("AFRICA", "africa", "Nowhere 0", "Loop 1")], "title string, found boolean")


@query
def id_to_title(spark, sf_dir):
    graph = views(spark, sf_dir).graph
    ids = graph.edges.select(F.col("dst").alias("id")).distinct().unionByName(spark.createDataFrame([(-1,)], "id long"))
    return graph.titles_of(ids).select("id", "title")


@query
def is_redirect(spark, sf_dir):
    return views(spark, sf_dir).graph.nodes.select("id", "is_redirect")


@query
def title_prefix_top10(spark, sf_dir):
    return views(spark, sf_dir).graph.prefix("Part 1", 10)


@query
def title_prefix_empty(spark, sf_dir):
    return views(spark, sf_dir).graph.prefix("", 10)


@query
def sort_by_title(spark, sf_dir):
    """The byte order of titles, as each title's place."""
    return positions(views(spark, sf_dir).graph.by_order("title")).select("title", "rank")


@query
def sort_by_id(spark, sf_dir):
    return positions(views(spark, sf_dir).graph.by_order("id")).select("id", "title", "rank")


@query
def random_title(spark, sf_dir):
    return spark.createDataFrame([(views(spark, sf_dir).graph.random_title(7),)], "title string")


# traversal
@query
def bfs_levels(spark, sf_dir):
    graph = views(spark, sf_dir).graph
    return paths.bfs_levels(graph, graph.by_title("Customer#000000000").select("id")).select("id", "depth")


def _route(spark, sf_dir, start, end):
    return paths.route(views(spark, sf_dir).graph, start, end)


@query
def route(spark, sf_dir):
    return _route(spark, sf_dir, "AFRICA", "Part 7")


@query
def route_redirects(spark, sf_dir):
    return _route(spark, sf_dir, "Merchant 3", "Supplier#000000003")


@query
def route_same_node(spark, sf_dir):
    return _route(spark, sf_dir, "ASIA", "ASIA")


@query
def route_unreachable(spark, sf_dir):
    return _route(spark, sf_dir, "Customer#000000000", "NATION_4")


@query
def route_missing_title(spark, sf_dir):
    asked = _requests(spark, ("Loop 0", "AFRICA"), ("AFRICA", "Nobody"), ("Nobody", "Loop 0"), ("AFRICA", "ASIA"))
    return paths.resolve(views(spark, sf_dir).nodes, asked).select("query_id", "status")


def _nation_requests(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    ends = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("end"))
    return nation.join(ends, F.col("k") == (F.col("n_nationkey") * 7 + 3) % 25).select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("start"), "end")


@query
def route_lengths_batch(spark, sf_dir):
    return paths.route_batch(views(spark, sf_dir).graph, _nation_requests(spark, sf_dir)).select("query_id", "status", F.coalesce("hops", F.lit(-1)).alias("hops"))


@query
def route_string(spark, sf_dir):
    asked = _requests(spark, ("AFRICA", "Part 7"), ("Loop 1", "Loop 3"), ("Customer#000000000", "NATION_4"))
    found = paths.route_batch(views(spark, sf_dir).graph, asked)
    return found.select("query_id", fn.route_string(F.col("route")).alias("text"))


# rendering and sizes
@query
def page_string(spark, sf_dir):
    return views(spark, sf_dir).graph.pages().select("id", fn.page_string(F.col("title"), F.col("id"), F.col("links")).alias("text"))


@query
def record_size(spark, sf_dir):
    return views(spark, sf_dir).graph.pages().select("id", fn.record_size(F.col("title"), F.col("links")).cast("long").alias("bytes"))


@query
def title_bytes(spark, sf_dir):
    return views(spark, sf_dir).graph.nodes.select("id", fn.title_bytes(F.col("title")).alias("bytes"))


@query
def benchmark_stats(spark, sf_dir):
    stats = series_statistics(_table(spark, sf_dir, "events"), "value")
    return stats.select("n", *(F.round(c, 4).alias(c) for c in ("min", "max", "mean", "stddev", "sum")))


# files
@query
def index_ranges(spark, sf_dir):
    """Orders as index lines, a hundred pages to a stream of 616 bytes a page."""
    orders = _table(spark, sf_dir, "orders")
    lines = orders.select(F.col("o_orderkey").alias("line_no"), F.concat_ws(":", F.expr("div(o_orderkey, 100) * 61600 + 600"), "o_orderkey", F.lit("Order")).alias("value"))
    return dumps.index_ranges(lines, 1 << 40)


def _folder(spark, df):
    lineage.checkpoint(spark.range(1))  # sets the folder where it is unset
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def _links(graph):
    return graph.pages().select("id", "title", "is_redirect", F.md5(F.array_join(F.col("links").cast("array<string>"), ",").cast("binary")).alias("links_md5"))


@query
def storage_roundtrip(spark, sf_dir):
    graph = views(spark, sf_dir).graph
    path = _folder(spark, graph.nodes)
    store.save_parquet(graph, path)
    return _links(store.load_parquet(spark, path))


def _legacy(spark, sf_dir, kind):
    """Through a file in the shared folder, which the driver must see as a local path: the formats are written by one process."""
    path = _folder(spark, None).removeprefix("file:")
    store.save(views(spark, sf_dir).graph, path, kind)
    try:
        return _links(Graph(*(lineage.stored(t) for t in store.unpacked(spark, f"file:{path}", kind))))
    finally:
        os.unlink(path)


@query
def buffer_roundtrip(spark, sf_dir):
    return _legacy(spark, sf_dir, "buffer")


@query
def segment_roundtrip(spark, sf_dir):
    return _legacy(spark, sf_dir, "segment")


@query
def xml_roundtrip(spark, sf_dir):
    """The dump written as XML and read back; ``same``: is the text what was written, byte for byte?"""
    dump = views(spark, sf_dir).dump
    escaped = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<page><title>"), escaped("title"), F.lit("</title><ns>"), F.col("ns").cast("string"), F.lit("</ns><id>"), (F.col("page_no") + 5_000_000_001).cast("string"), F.lit('</id><revision><text xml:space="preserve">'), escaped("text"), F.lit("</text></revision></page>"))
    path = _folder(spark, dump)
    dump.repartitionByRange("page_no").sortWithinPartitions("page_no").select(xml.alias("value")).write.text(path)
    # the order of links in a text isn't the same in every engine, so texts are compared by hash here
    written = dump.select("page_no", F.md5(F.col("text").cast("binary")).alias("md5"))
    read = dumps.xml_dump(spark, path).select("page_no", "ns", "title", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("read_md5"))
    return read.join(written, "page_no").select("page_no", "ns", "title", "chars", (F.col("read_md5") == F.col("md5")).alias("same"))


@query
def bz2_streams(spark, sf_dir):
    """Files of a thousand customers each, one compressed stream a customer: what every range that is found decompresses to."""

    @F.pandas_udf("binary")
    def compressed(names: pd.Series) -> pd.Series:
        return names.map(lambda own: b"".join(bz2.compress(name.encode()) for name in own))

    def texts(frames):
        for frame in frames:
            yield frame.assign(text=[bz2.decompress(own).decode() for own in frame["text"]])

    customers = _table(spark, sf_dir, "customer").withColumn("path", F.expr("cast(div(c_custkey, 1000) as string)"))
    names = customers.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("own"))
    files = lineage.stored(names.select("path", compressed(F.col("own.c_name")).alias("content")))
    # streams are numbered without their bytes, and each is cut out where it meets its file: a file isn't copied for every stream
    ranges = dumps.streams_of(files).withColumn("stream", F.row_number().over(W.partitionBy("path").orderBy("start")).cast("long"))
    own = F.expr("substring(content, cast(start + 1 as int), cast(stop - start as int))")
    return ranges.join(files, "path").select("path", "stream", own.alias("text")).mapInPandas(texts, "path string, stream long, text string")
