"""Ingest rules against plain Python models."""

import random

from pagegraph.operators import ingest
from pagegraph.operators.ranking import dense_index
from pagegraph.sources.store import graph_of

DUMP = "page_no long, ns int, title string, text string"


def links(graph):
    titles = {r.id: r.title for r in graph.nodes.collect()}
    return {(titles[e.src], titles[e.dst]) for e in graph.edges.collect()}


def test_articles_redirects_and_duplicates(spark):
    rows = [
        (10, 0, "Alpha", "[[beta]] [[Beta|again]] [[File:x.png]] [[Gone]] [[ß]] [[Alpha]]"),
        (11, 1, "Talk:Alpha", "[[Beta]]"),
        (12, 0, "Beta", None),
        (13, 0, "Gamma", "#REDIRECT [[Alpha]]"),
        (14, 0, "Delta", "#redirect [[Unknown]]"),
        (15, 0, "Epsilon", "#REDIRECT [[Gone]]"),
        (16, 0, "Beta", "[[gamma]]"),
    ]
    dump = spark.createDataFrame(rows, DUMP)
    graph = graph_of(dump)
    assert links(graph) == {("Alpha", "Beta"), ("Alpha", "Alpha"), ("Gamma", "Alpha"), ("Beta", "Gamma")}
    # the later Beta wins, its id leaves a gap; Delta's target is nowhere, Epsilon's is at least linked to
    assert {(r.id, r.title) for r in graph.nodes.collect()} == {(0, "Alpha"), (5, "Beta"), (2, "Gamma"), (4, "Epsilon")}
    parsed = ingest.parse(ingest.main_pages(dump))
    latest, universe = ingest.last_wins(parsed), ingest.title_universe(parsed)
    # titles: Alpha Beta Gamma Delta Epsilon Gone ß
    assert universe.count() == 7
    assert ingest.statistics(latest, universe).first().asDict() == {"articles": 2, "redirects": 3, "links": 3, "null_links": 2 + 2}


def drop_model(redirects, articles, universe):
    """A literal walk over redirects in id order, each failing one taken out before the next starts."""
    alive, gone = dict(redirects), set()
    by_title = {t: i for i, (t, _) in redirects.items()}
    for i in sorted(redirects):
        seen, at, ok = set(), i, True
        while True:
            if at in seen:
                ok = False
                break
            seen.add(at)
            target = alive[at][1]
            if target not in universe:
                ok = False
                break
            at = by_title.get(target)
            if at is None or at not in alive or target in articles:
                break
        if not ok:
            gone.add(i)
            del alive[i]
    return gone


def test_redirect_cleanup_against_model(spark):
    rng = random.Random(5)
    for _ in range(4):
        n = 40
        titles = [f"T{i}" for i in range(n)]
        articles = set(rng.sample(titles, 4))
        red = {"Red0", "Red1"}
        redirects = {i: (t, rng.choice([*titles, "Red0", "Nowhere"])) for i, t in enumerate(titles) if t not in articles}
        rows = [(i, 0, t, "[[Red0]] [[Red1]]" if t in articles else f"#REDIRECT [[{redirects[i][1]}]]") for i, t in enumerate(titles)]
        parsed = ingest.parse(ingest.main_pages(spark.createDataFrame(rows, DUMP)))
        got = {r.id for r in ingest.dropped_redirects(ingest.last_wins(parsed), ingest.title_universe(parsed)).collect()}
        assert got == drop_model(redirects, articles, set(titles) | red)


def test_three_cycle_keeps_two(spark):
    rows = [(0, 0, "Foo", ""), (1, 0, "A", "#REDIRECT [[C]]"), (2, 0, "B", "#REDIRECT [[A]]"), (3, 0, "C", "#REDIRECT [[B]]")]
    assert graph_of(spark.createDataFrame(rows, DUMP)).nodes.where("is_redirect").count() == 2


def test_empty_dump(spark):
    graph = graph_of(spark.createDataFrame([], DUMP))
    assert graph.nodes.isEmpty() and graph.edges.isEmpty() and graph.random_title() is None


def test_dense_index_is_dense(spark):
    keys = random.Random(1).sample(range(-500_000, 500_000), 300)
    got = {r.k: r.i for r in dense_index(spark.createDataFrame([(k,) for k in keys], "k long"), "k", "i", bucket_size=1000).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_streamed_rows_parse_alike(spark, tmp_path):
    from pagegraph.streaming import parsed_pages

    rows = [(0, 0, "Alpha", "[[beta]] [[File:x]]"), (1, 1, "Talk:Alpha", "[[Beta]]"), (2, 0, "Gamma", "#REDIRECT [[Alpha]]")]
    dump = spark.createDataFrame(rows, DUMP)
    dump.write.parquet(str(tmp_path / "in"))
    stream = parsed_pages(spark.readStream.schema(dump.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("parsed").select("id", "target", "link_titles").collect())) == [(0, None, ["Beta"]), (2, "Alpha", [])]
