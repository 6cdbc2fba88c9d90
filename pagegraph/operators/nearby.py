"""Small searches on the driver: links are fetched a frontier at a time, within a stated bound.

A round is one job that reads the links of the frontier's nodes, by a filter that the
sorted edge tables can prune by.  All that is held is counted against ``most``, ids and
links alike; ``TooLarge`` hands the search back to the distributed operators.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph


class TooLarge(Exception):
    """More links than the driver is to hold."""


class Links:
    """The links of nodes asked for so far, along (``out``) or against their direction."""

    def __init__(self, graph: Graph, out: bool, most: int):
        edges = graph.edges if out else graph.incoming
        self.table = edges.select(F.col("src" if out else "dst").alias("node"), F.col("dst" if out else "src").alias("to"))
        self.known: dict[int, list[int]] = {}
        self.room = most

    def of(self, nodes: set[int]) -> dict[int, list[int]]:
        """Each node with its links, ascending."""
        missing = sorted(nodes - self.known.keys())
        if missing:
            self.room -= len(missing)
            if self.room < 0:
                raise TooLarge
            if len(missing) <= 500:
                found = self.table.where(F.col("node").isin(missing))
            else:
                spark = self.table.sparkSession
                found = self.table.where(F.col("node").between(missing[0], missing[-1])).join(F.broadcast(spark.createDataFrame([(i,) for i in missing], "node long")), "node")  # ``most`` ids at most
            rows = found.limit(self.room + 1).toArrow()
            self.room -= rows.num_rows
            if self.room < 0:
                raise TooLarge
            for i in missing:
                self.known[i] = []
            for node, to in zip(rows.column("node").to_pylist(), rows.column("to").to_pylist()):
                self.known[node].append(to)
            for i in missing:
                self.known[i].sort()
        return {i: self.known[i] for i in nodes}

    def has(self, node: int, to: int) -> bool:
        own = self.known[node]
        at = bisect_left(own, to)
        return at < len(own) and own[at] == to


def levels(graph: Graph, starts: DataFrame, most: int, most_levels: int | None) -> tuple[dict[int, int], set[int], int]:
    """Depths of the nodes that ``starts(id)`` reach, the last frontier and its depth, as far as ``most`` allows; an empty frontier ends the search."""
    rows = starts.select("id").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise TooLarge
    links, frontier, depth = Links(graph, True, most), {r.id for r in rows}, 0
    found = dict.fromkeys(frontier, 0)
    while frontier and (most_levels is None or depth < most_levels):
        try:
            reached = links.of(frontier)
        except TooLarge:
            break
        depth += 1
        frontier = {to for own in reached.values() for to in own} - found.keys()
        found |= dict.fromkeys(frontier, depth)
    return found, frontier, depth


class _Search:
    """One request: levels from both ends until they meet."""

    def __init__(self, start: int, end: int):
        self.ahead, self.behind = [{start}], [{end}]
        self.seen = ({start}, {end})
        self.met = self.ahead[0] & self.behind[0]

    @property
    def open(self) -> bool:
        return not self.met and bool(self.ahead[-1]) and bool(self.behind[-1])

    def forward(self) -> bool:
        return len(self.ahead[-1]) <= len(self.behind[-1])

    def expand(self, links: Links) -> None:
        side, seen = (self.ahead, self.seen[0]) if self.forward() else (self.behind, self.seen[1])
        reached = links.of(side[-1])
        side.append({to for own in reached.values() for to in own} - seen)
        seen |= side[-1]
        self.met = self.ahead[-1] & self.behind[-1]

    def route(self, out: Links, back: Links) -> list[int] | None:
        """The shortest route that takes the smallest id at each step."""
        if not self.met:
            return None
        marked = [self.met]
        for level in self.ahead[-2::-1]:
            marked.append({i for i in level if not marked[-1].isdisjoint(out.known[i])})
        route = [*marked.pop()]
        for on_route in reversed(marked):
            route.append(min(on_route.intersection(out.known[route[-1]])))
        for level in self.behind[-2::-1]:
            route.append(min(i for i in level if back.has(i, route[-1])))
        return route


def routes(graph: Graph, pairs: list[tuple], most: int) -> dict:
    """query_id -> ids of the shortest route of each (query_id, start_id, end_id) that has one."""
    out, back = Links(graph, True, most), Links(graph, False, most)
    searches = {q: _Search(a, b) for q, a, b in pairs}
    while any(s.open for s in searches.values()):
        going = [s for s in searches.values() if s.open]
        if sum(len(x) for s in going for x in s.seen) > most:
            raise TooLarge
        for links, side in ((out, True), (back, False)):  # one job for all requests that go this way
            links.of({i for s in going if s.forward() is side for i in (s.ahead if side else s.behind)[-1]})
        for s in going:
            s.expand(out if s.forward() else back)
    return {q: r for q, s in searches.items() if (r := s.route(out, back)) is not None}
