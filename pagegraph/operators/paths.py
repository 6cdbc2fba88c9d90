"""Breadth-first levels and shortest routes, many at a time.

A search is level-synchronous from both ends.  Each round expands the side whose frontier
has fewer nodes, for all requests still open at once; the first round in which the sides
meet gives the length.  Then the nodes on shortest routes are marked from the meeting
nodes outwards, and the route takes the smallest id at each step.  Levels are
checkpointed, so the plan of a round holds one expansion only.

Searches that touch at most ``near`` nodes and links are done on the driver, a job a round;
larger ones start anew, or go on, distributed.  The results are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpoint
from . import nearby
from .graph import Graph

NEAR = 2_000_000  # some 300 MB of Python objects on the driver at most


def bfs_levels(graph: Graph, starts: DataFrame, *, most_levels: int | None = None, near: int = NEAR) -> DataFrame:
    """(id, depth) of every node that ``starts(id)`` reach."""
    spark = graph.edges.sparkSession
    try:
        found, ahead, depth = nearby.levels(graph, starts, near, most_levels)
        seen = spark.createDataFrame(list(found.items()), "id long, depth int")
        if not ahead or depth == most_levels:
            return seen
        frontier = seen.where(F.col("depth") == depth)
    except nearby.TooLarge:
        frontier = checkpoint(starts.select("id").distinct().withColumn("depth", F.lit(0)))
        seen, depth = frontier, 0
    while most_levels is None or depth < most_levels:
        depth += 1
        reached = frontier.select(F.col("id").alias("src")).join(graph.edges, "src").select(F.col("dst").alias("id")).distinct()
        frontier = checkpoint(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)
    return seen


def resolve(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(query_id, start, end)`` with the ids of both titles and a status: missing_start, missing_end, missing_both or ok."""
    ids = nodes.select("title", "id")
    found = requests.join(ids.select(F.col("title").alias("start"), F.col("id").alias("start_id")), "start", "left").join(ids.select(F.col("title").alias("end"), F.col("id").alias("end_id")), "end", "left")
    no_start, no_end = F.col("start_id").isNull(), F.col("end_id").isNull()
    status = F.when(no_start & no_end, "missing_both").when(no_start, "missing_start").when(no_end, "missing_end").otherwise("ok")
    return found.select("query_id", "start", "end", "start_id", "end_id", status.alias("status"))


class _Side:
    """One end of a batch of searches: its levels of (query_id, node)."""

    def __init__(self, first: DataFrame, edges: DataFrame):
        self.levels, self.edges, self.size = [first], edges, None  # edges(node, to)

    def cost(self) -> int:
        """Nodes of the frontier, requests that are settled included: the level is stored, so this is only a count."""
        if self.size is None:
            self.size = self.levels[-1].count()
        return self.size

    def expand(self, open_: DataFrame) -> None:
        seen = reduce(DataFrame.unionByName, self.levels)
        reached = self.levels[-1].join(open_, "query_id", "left_semi").join(self.edges, "node").select("query_id", F.col("to").alias("node")).distinct()
        self.size = None
        self.levels.append(checkpoint(reached.join(seen, ["query_id", "node"], "left_anti")))

    def marked(self, met: DataFrame, depth: str) -> list[DataFrame]:
        """For each level the nodes on a shortest way to the meeting nodes ``met(query_id, node, <depth>)``."""
        out: list[DataFrame] = []
        for i in range(len(self.levels) - 1, -1, -1):
            own = met.where(F.col(depth) == i).select("query_id", "node")
            if out:
                back = self.levels[i].join(self.edges, "node").join(out[-1].select("query_id", F.col("node").alias("to")), ["query_id", "to"]).select("query_id", "node")
                own = own.unionByName(back).distinct()
            out.append(checkpoint(own))
        return out[::-1]


def _tables(graph: Graph, kind: str, routes: dict) -> tuple[DataFrame, DataFrame]:
    spark = graph.edges.sparkSession
    hops = spark.createDataFrame([(q, len(r) - 1) for q, r in routes.items()], f"query_id {kind}, hops int")
    return hops, spark.createDataFrame([(q, step, i) for q, r in routes.items() for step, i in enumerate(r)], f"query_id {kind}, step int, id long")


def search(graph: Graph, pairs: DataFrame, *, most_rounds: int = 10_000, near: int = NEAR, most_near_pairs: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """For ``pairs(query_id, start_id, end_id)``: (query_id, hops), and the routes (query_id, step, id); unreachable ends are in neither."""
    pairs = pairs.select("query_id", "start_id", "end_id")
    few = pairs.limit(most_near_pairs + 1).collect() if near else []
    if near and len(few) <= most_near_pairs:
        try:
            return _tables(graph, pairs.schema["query_id"].dataType.simpleString(), nearby.routes(graph, [tuple(r) for r in few], near))
        except nearby.TooLarge:
            pass
    pairs = checkpoint(pairs)
    ahead = _Side(checkpoint(pairs.select("query_id", F.col("start_id").alias("node"))), graph.edges.select(F.col("src").alias("node"), F.col("dst").alias("to")))
    behind = _Side(checkpoint(pairs.select("query_id", F.col("end_id").alias("node"))), graph.incoming.select(F.col("dst").alias("node"), F.col("src").alias("to")))
    met = checkpoint(ahead.levels[0].join(behind.levels[0], ["query_id", "node"]).select("query_id", "node", F.lit(0).alias("ahead"), F.lit(0).alias("behind")))
    open_ = checkpoint(pairs.select("query_id").join(met, "query_id", "left_anti"))
    for _ in range(most_rounds):
        if open_.isEmpty():
            break
        side = ahead if ahead.cost() <= behind.cost() else behind
        side.expand(open_)
        meeting = ahead.levels[-1].join(behind.levels[-1], ["query_id", "node"]).join(open_, "query_id", "left_semi")
        meeting = checkpoint(meeting.select("query_id", "node", F.lit(len(ahead.levels) - 1).alias("ahead"), F.lit(len(behind.levels) - 1).alias("behind")))
        met = met.unionByName(meeting)
        alive = side.levels[-1].select("query_id").distinct()
        open_ = checkpoint(open_.join(meeting, "query_id", "left_anti").join(alive, "query_id", "left_semi"))
    met = checkpoint(met)
    hops = met.groupBy("query_id").agg(F.min(F.col("ahead") + F.col("behind")).alias("hops"))

    # nodes on shortest routes by their step, then the smallest at each step that the one before links to
    on_route = [level.select("query_id", F.lit(i).alias("step"), "node") for i, level in enumerate(ahead.marked(met, "ahead"))]
    for j, level in enumerate(behind.marked(met, "behind")):
        on_route.append(level.join(hops, "query_id").select("query_id", (F.col("hops") - j).cast("int").alias("step"), "node"))
    on_route = checkpoint(reduce(DataFrame.unionByName, on_route).distinct())
    longest = hops.agg(F.max("hops")).first()[0] or 0
    here = on_route.where("step = 0").select("query_id", "node")
    route = [here.select("query_id", F.lit(0).alias("step"), "node")]
    for step in range(1, longest + 1):
        ahead_nodes = on_route.where(F.col("step") == step).select("query_id", F.col("node").alias("to"))
        here = checkpoint(here.join(ahead.edges, "node").join(ahead_nodes, ["query_id", "to"]).groupBy("query_id").agg(F.min("to").alias("node")))
        route.append(here.select("query_id", F.lit(step).alias("step"), "node"))
    return hops, reduce(DataFrame.unionByName, route).withColumnRenamed("node", "id")


def route_batch(graph: Graph, requests: DataFrame) -> DataFrame:
    """Answers ``requests(query_id, start, end)``: status (ok, unreachable or missing_*), hops and the route's titles in order, both ends included."""
    asked = checkpoint(resolve(graph.nodes, requests))
    hops, steps = search(graph, asked.where("status = 'ok'"))
    titled = steps.join(graph.nodes.select("id", "title"), "id")
    routes = titled.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "title"))), lambda s: s["title"]).alias("route"))
    out = asked.join(hops, "query_id", "left").join(routes, "query_id", "left")
    status = F.when((F.col("status") == "ok") & F.col("hops").isNull(), "unreachable").otherwise(F.col("status"))
    return out.select("query_id", "start", "end", status.alias("status"), F.col("hops").cast("int").alias("hops"), F.coalesce("route", F.array().cast("array<string>")).alias("route"))


class RouteError(LookupError):
    """A route was asked for between titles of which at least one has no page."""

    def __init__(self, start: str, end: str, start_missing: bool, end_missing: bool):
        self.start, self.end, self.start_missing, self.end_missing = start, end, start_missing, end_missing
        super().__init__(", ".join(f"no page named {t!r}" for t, m in ((start, start_missing), (end, end_missing)) if m))


def route(graph: Graph, start: str, end: str) -> DataFrame:
    """The steps (step, id, title) of a shortest route, empty if there is none; RouteError if a title has no page."""
    ids = {r.title: r.id for r in graph.nodes.where(F.col("title").isin(start, end)).select("title", "id").collect()}
    if start not in ids or end not in ids:
        raise RouteError(start, end, start not in ids, end not in ids)
    pair = graph.nodes.sparkSession.createDataFrame([(0, ids[start], ids[end])], "query_id int, start_id long, end_id long")
    return search(graph, pair)[1].select("step", "id").join(graph.nodes.select("id", "title"), "id").select("step", "id", "title")
