"""Dumps, indexes, storage formats and the command line."""

import bz2

import pytest

from pagegraph import cli
from pagegraph.operators.graph import Graph
from pagegraph.sources import dump, legacy, store

XML = """<mediawiki><siteinfo><sitename>x</sitename></siteinfo>
<page><title>Alpha</title><ns>0</ns><id>5000000001</id><revision><id>1</id><text xml:space="preserve">[[Beta]] &amp; [[beta|b]]</text></revision></page>
<page><title>Beta</title><ns>0</ns><id>5000000002</id><revision><id>2</id><text xml:space="preserve">Plain text</text></revision></page>
<page><title>Talk:Beta</title><ns>1</ns><id>5000000004</id><revision><id>4</id><text /></revision></page>
<page><title>Gamma</title><ns>0</ns><id>5000000003</id><revision><id>3</id><text xml:space="preserve">#REDIRECT [[Alpha]]</text></revision></page>
</mediawiki>
"""


def write_dump(path, pages=0):
    """A plain or multistream dump; the index of the latter."""
    body = XML.encode()
    if not str(path).endswith(".bz2"):
        path.write_bytes(body)
        return
    at = body.index(b"<page><title>Beta")
    streams = [bz2.compress(body[:at]), bz2.compress(body[at:])]
    path.write_bytes(b"".join(streams))
    index = path.parent / path.name.replace(".xml.bz2", "-index.txt.bz2")
    index.write_bytes(bz2.compress(f"0:1:Alpha\n{len(streams[0])}:2:Beta\n{len(streams[0])}:3:Gamma\n".encode()))


@pytest.mark.parametrize("name", ["a.xml", "a-multistream.xml.bz2"])
def test_dump(spark, tmp_path, name):
    write_dump(tmp_path / name)
    rows = dump.xml_dump(spark, str(tmp_path / name)).orderBy("page_no").collect()
    assert [(r.page_no, r.ns, r.title) for r in rows] == [(0, 0, "Alpha"), (1, 0, "Beta"), (2, 1, "Talk:Beta"), (3, 0, "Gamma")]
    assert rows[0].text == "[[Beta]] & [[beta|b]]" and rows[2].text == ""
    graph = store.load(spark, str(tmp_path / name), "XML")
    assert {(p.id, p.title, p.is_redirect, tuple(p.links)) for p in graph.pages().collect()} == {(0, "Alpha", False, (1,)), (1, "Beta", False, ()), (2, "Gamma", True, (0,))}


def lines(spark, *values):
    return spark.createDataFrame([(i * 70_000, v) for i, v in enumerate(values)], "line_no long, value string")


def test_index_ranges(spark):
    got = dump.index_ranges(lines(spark, "600:1:A", "600:2:B", "", "9000000000:3:C:D"), 10_000_000_000)
    assert sorted(map(tuple, got.collect())) == [(0, 600), (600, 9_000_000_000), (9_000_000_000, 10_000_000_000)]
    assert dump.index_ranges(lines(spark, "", "  "), 10).count() == 0


@pytest.mark.parametrize("bad", [[":1"], ["x:1"], ["12"], ["-1:2"], ["10:1"], ["5:1", "4:1"]])
def test_bad_index(spark, bad):
    with pytest.raises(ValueError):
        dump.index_ranges(lines(spark, *bad), 10)


def test_bad_index_is_not_fatal(spark, tmp_path):
    write_dump(tmp_path / "b.xml.bz2")
    (tmp_path / "bad.txt").write_text("nonsense\n")
    assert dump.xml_dump(spark, str(tmp_path / "b.xml.bz2"), index=str(tmp_path / "bad.txt")).count() == 4


def test_sidecar_names():
    assert dump.sidecar_index("d/x.xml.bz2") == "d/x-index.txt.bz2"
    assert dump.sidecar_index("x.bz2") == "x-index.txt.bz2"
    assert dump.sidecar_index("x.xml") == "x.xml-index.txt.bz2"


def test_stream_starts(spark, tmp_path):
    one, two = bz2.compress(b"one"), bz2.compress(b"two" * 50)
    assert dump.stream_starts(b"junk" + one + two) == [(4, 4 + len(one)), (4 + len(one), 4 + len(one) + len(two))]
    assert dump.stream_starts(b"") == [] == dump.stream_starts(b"BZh0" + one[4:])
    (tmp_path / "s.bz2").write_bytes(one + two)
    assert [tuple(r)[1:] for r in dump.bz2_streams(spark, str(tmp_path / "s.bz2")).orderBy("start").collect()] == [(0, len(one)), (len(one), len(one) + len(two))]


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([(1, "ąb", False), (2, "b_%", True), (5, "Z", False)], "id long, title string, is_redirect boolean")
    return Graph(nodes, spark.createDataFrame([(1, 2), (1, 5), (2, 1), (5, 5)], "src long, dst long"))


def pages(g):
    return {(p.id, p.title, p.is_redirect, tuple(p.links)) for p in g.pages().collect()}


@pytest.mark.parametrize("kind", ["parquet", "buffer", "Segment"])
def test_formats_round_trip(spark, tmp_path, graph, kind):
    path = str(tmp_path / "g")
    store.save(graph, path, kind)
    assert pages(store.load(spark, path, kind)) == pages(graph)
    with pytest.raises(Exception):
        store.save(graph, path, kind)


def test_format_errors(spark, tmp_path, graph):
    with pytest.raises(ValueError):
        store.load(spark, "x", "csv")
    with pytest.raises(ValueError):
        list(legacy.parse_buffer(b"0123456789abcdef"))
    with pytest.raises(ValueError):
        list(legacy.parse_segment(bytes(200)))
    with pytest.raises(ValueError):
        store.check(Graph(graph.nodes, spark.createDataFrame([(1, 77)], "src long, dst long")))
    with pytest.raises(ValueError):
        legacy.write_segment(Graph(graph.nodes.limit(0), graph.edges.limit(0)), str(tmp_path / "none"))


def test_prefix_is_literal_and_in_byte_order(graph):
    assert [r.title for r in graph.prefix("b_", 10).collect()] == ["b_%"]
    assert [r.title for r in graph.prefix("", 2).collect()] == ["Z", "b_%"]
    assert graph.prefix("", 0).count() == 0


def test_prompt(graph):
    said = []
    answers = iter(["#", "b#", "nobody", " Z ", "ąb", "Z", "b_%"])

    def read(prompt):
        try:
            return next(answers)
        except StopIteration:
            raise EOFError from None

    cli.interactive(graph, read, said.append)
    assert said[1] == 'Wildcards: "b_%"' and said[2] == '"nobody" is no title of this graph'
    assert said[3].startswith("Route: No route found") is True
    assert cli.answer(graph, "<")[0] in {"ąb", "b_%", "Z"}


def test_command_line(spark, tmp_path, capsys):
    write_dump(tmp_path / "c.xml")
    source, target = str(tmp_path / "c.xml"), str(tmp_path / "c.graph")
    assert cli.main([]) == cli.HELP_SHOWN
    assert cli.main(["query", "--input", source, "--input-format", "xml"], spark) == cli.GENERAL_ERROR
    assert cli.main(["convert", "--input", source], spark) == cli.GENERAL_ERROR
    assert cli.main(["convert", "--input", source, "--output", target, "--index", "i"], spark) == cli.GENERAL_ERROR
    assert cli.main(["convert", "--input", source, "--output", target], spark) == 0
    capsys.readouterr()
    assert cli.main(["query", "--input", target, "--start", "Gamma", "--end", "Beta"], spark) == 0
    assert capsys.readouterr().out == '"Gamma" -> "Alpha" -> "Beta"\n'
    assert cli.main(["query", "--input", target, "--start", "Gamma", "--end", "X"], spark) == cli.GENERAL_ERROR
