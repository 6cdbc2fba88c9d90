"""Routes and levels against breadth-first search in plain Python."""

import random
from collections import deque

import pytest

from pagegraph.operators import paths
from pagegraph.operators.graph import Graph, series_statistics


def graph_from(spark, n, edges):
    nodes = spark.createDataFrame([(i, f"N{i}", False) for i in range(n)], "id long, title string, is_redirect boolean")
    return Graph(nodes, spark.createDataFrame(sorted(edges), "src long, dst long"))


def distances(n, edges, start):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    depth, queue = {start: 0}, deque([start])
    while queue:
        a = queue.popleft()
        for b in out.get(a, ()):
            if b not in depth:
                depth[b] = depth[a] + 1
                queue.append(b)
    return depth


def smallest(n, edges, start, end):
    away = distances(n, {(b, a) for a, b in edges}, end)
    if start not in away:
        return []
    route = [start]
    while route[-1] != end:
        route.append(min(b for a, b in edges if a == route[-1] and away.get(b) == away[route[-1]] - 1))
    return route


def test_batch_against_model(spark):
    rng = random.Random(3)
    n = 60
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(110)}
    graph = graph_from(spark, n, edges)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(25)] + [(4, 4)]
    requests = spark.createDataFrame([(q, f"N{a}", f"N{b}") for q, (a, b) in enumerate(pairs)] + [(99, "N1", "?"), (98, "?", "!")], "query_id int, start string, end string")
    got = {r.query_id: r for r in paths.route_batch(graph, requests).collect()}
    for q, (a, b) in enumerate(pairs):
        want = smallest(n, edges, a, b)
        assert got[q].route == [f"N{i}" for i in want]
        assert (got[q].status, got[q].hops) == (("ok", len(want) - 1) if want else ("unreachable", None))
    assert got[99].status == "missing_end" and got[98].status == "missing_both"


def test_levels_against_model(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(80), rng.randrange(80)) for _ in range(120)}
    graph = graph_from(spark, 80, edges)
    got = {r.id: r.depth for r in paths.bfs_levels(graph, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == distances(80, edges, 0)


def test_unknown_titles_are_an_error(spark):
    graph = graph_from(spark, 3, {(0, 1), (1, 2)})
    with pytest.raises(paths.RouteError) as error:
        paths.route(graph, "N0", "nobody")
    assert (error.value.start_missing, error.value.end_missing) == (False, True)
    assert [r.title for r in paths.route(graph, "N0", "N2").orderBy("step").collect()] == ["N0", "N1", "N2"]


def test_statistics_of_one_value(spark):
    row = series_statistics(spark.createDataFrame([(2.5,)], "v double"), "v").first()
    assert (row.n, row.mean, row.stddev) == (1, 2.5, 0.0)


def test_distributed_search_gives_the_same(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(50), rng.randrange(50)) for _ in range(90)}
    graph = graph_from(spark, 50, edges)
    pairs = spark.createDataFrame([(q, rng.randrange(50), rng.randrange(50)) for q in range(12)], "query_id int, start_id long, end_id long")
    tables = [[sorted(map(tuple, t.collect())) for t in paths.search(graph, pairs, near=near)] for near in (0, 5, 1_000_000)]
    assert tables[0] == tables[1] == tables[2]
    start = spark.createDataFrame([(0,)], "id long")
    for near in (0, 3, 20, 60):
        assert {r.id: r.depth for r in paths.bfs_levels(graph, start, near=near).collect()} == distances(50, edges, 0)
    assert {r.id for r in paths.bfs_levels(graph, start, most_levels=1, near=20).collect()} == {i for i, d in distances(50, edges, 0).items() if d <= 1}
