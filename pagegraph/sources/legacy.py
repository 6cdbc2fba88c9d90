"""Importers and exporters for the two single-file binary graph formats.

Both formats hold 32-bit ids.  A file at a local path that all machines share is read and
written by ranges: export sorts pages into chunks of bytes, of which the driver learns
only the sizes, and tasks then write each chunk to its place; import reads ranges of
records, found by the sizes in the records' heads or by the table of nodes.  Other paths
are read whole, a file a task, of 2 GiB at most.
"""

from __future__ import annotations

import os
import struct
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import discard, stored, visible
from ..operators.graph import Graph

# Fixed values of the formats.
BUFFER_MAGIC = 0x823890 + 1
BUFFER_HEADER = struct.Struct(">iq")  # magic, pages
BUFFER_RECORD = struct.Struct("<ihihi")  # id (negative: redirect), links, where they start, title bytes, where it starts
SEGMENT_MAGIC = 0x574B475241463031
SEGMENT_VERSION = 1
SEGMENT_HEADER_BYTES = 176
SEGMENT_REDIRECT = 1
SEGMENT_NODE = np.dtype({"names": ["title", "title_bytes", "flags", "id", "out", "out_degree", "in", "in_degree"], "formats": ["<i8", "<i4", "<i4", "<i4", "<i8", "<i4", "<i8", "<i4"], "offsets": [0, 8, 12, 16, 24, 32, 40, 48], "itemsize": 56})
SEGMENT_NAME = np.dtype([("key", "<i8"), ("bytes", "<i4"), ("id", "<i4")])
SEGMENT_ID = np.dtype([("id", "<i4"), ("rank", "<i4")])
SECTIONS = ("nodes", "titles", "out", "in", "names", "name_keys", "ids")

PAGE = "id long, title string, is_redirect boolean, links array<bigint>"


def _batches(rows, most: int = 10_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held)
            held = []
    yield _batch(held)


def _batch(rows):
    kinds = (pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()))
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "title", "is_redirect", "links"])


def _read(spark: SparkSession, path: str, parse, split) -> DataFrame:
    """Pages by ``split(path)`` -> ((start, stop, pages) ranges, parser of a range), or of whole files where the path isn't local."""
    visible(spark)
    local = path.removeprefix("file://").removeprefix("file:")
    if os.path.isfile(local):
        ranges, pages_of = split(local)

        def run_ranges(batches):
            with open(local, "rb") as f:
                for batch in batches:
                    for row in batch.to_pylist():
                        yield from _batches(pages_of(f, **row), 2_000)

        rows = spark.createDataFrame(ranges, "start long, stop long, pages long")
        return rows.repartitionByRange(max(1, min(len(ranges), 4_096)), "start").mapInArrow(run_ranges, PAGE)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(parse(content.as_buffer()))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PAGE)


def _at(f, place: int, size: int) -> bytes:
    """``size`` bytes of a file from ``place``; ValueError if it ends before."""
    f.seek(place)
    data = f.read(size)
    if len(data) < size:
        raise ValueError("the file ends too early")
    return data


def _buffer_pages(data) -> int:
    if len(data) < BUFFER_HEADER.size:
        raise ValueError("too short for a buffer file")
    magic, pages = BUFFER_HEADER.unpack_from(data)
    if magic != BUFFER_MAGIC:
        raise ValueError("not a buffer file of this version")
    return pages


def _buffer_records(data, at: int, pages: int):
    for _ in range(pages):
        number, links, links_at, title_bytes, title_at = BUFFER_RECORD.unpack_from(data, at)
        title = bytes(data[at + title_at : at + title_at + title_bytes]).decode("utf-8", "replace")
        yield abs(number), title, number < 0, np.frombuffer(data, "<i4", links, at + links_at).tolist()
        at += BUFFER_RECORD.size + 4 * links + title_bytes


def parse_buffer(data):
    """Pages of a buffer file; a page whose id is 0 can't be told from a redirect with that id."""
    data = memoryview(data)
    yield from _buffer_records(data, BUFFER_HEADER.size, _buffer_pages(data))


def split_buffer(path: str, size: int = 8 << 20):
    """Ranges of whole records of some ``size`` bytes: heads are walked through once, a block at a time."""
    ranges, head = [], BUFFER_RECORD.size
    with open(path, "rb") as f:
        pages = _buffer_pages(f.read(BUFFER_HEADER.size))
        start = at = BUFFER_HEADER.size
        block, begins, held, sizes = b"", at, 0, struct.Struct("<4xh4xh")
        for _ in range(pages):
            if at + head > begins + len(block):
                f.seek(at)
                block, begins = f.read(size), at
                if len(block) < head:
                    raise ValueError("the file ends too early")
            links, title_bytes = sizes.unpack_from(block, at - begins)
            at += head + 4 * links + title_bytes
            held += 1
            if at - start >= size:
                ranges.append((start, at, held))
                start, held = at, 0
    if held:
        ranges.append((start, at, held))
    return ranges, lambda f, start, stop, pages: _buffer_records(memoryview(_at(f, start, stop - start)), 0, pages)


def _segment_header(data, size: int) -> tuple[int, int, dict]:
    """Nodes, edges and the sections' (start, size)."""
    if len(data) < SEGMENT_HEADER_BYTES:
        raise ValueError("too short for a segment file")
    magic, version, _, nodes, edges, edges_in, *places = struct.unpack_from("<qiiqqq14q", data)
    if (magic, version) != (SEGMENT_MAGIC, SEGMENT_VERSION):
        raise ValueError("not a segment file of this version")
    section = {name: (places[2 * i], places[2 * i + 1]) for i, name in enumerate(SECTIONS)}
    if not nodes or edges != edges_in or any(start < 0 or length < 0 or start + length > size for start, length in section.values()):
        raise ValueError("a segment file with an impossible header")
    return nodes, edges, section


def _segment_records(table, title_of, links_of):
    for node in table:
        title = bytes(title_of(int(node["title"]), int(node["title_bytes"]))).decode("utf-8", "replace")
        yield int(node["id"]), title, bool(node["flags"] & SEGMENT_REDIRECT), np.frombuffer(links_of(4 * int(node["out"]), 4 * int(node["out_degree"])), "<i4").tolist()


def parse_segment(data):
    """Pages of a segment file, in id order."""
    data = memoryview(data)
    nodes, _, section = _segment_header(data, len(data))
    cut = lambda name: lambda at, size: data[section[name][0] + at : section[name][0] + at + size]
    yield from _segment_records(np.frombuffer(data, SEGMENT_NODE, nodes, section["nodes"][0]), cut("titles"), cut("out"))


def split_segment(path: str, size: int = 20_000):
    """Ranges of ``size`` nodes; what they name is read in one piece where it lies together, as it does in files of ``write_segment``."""
    with open(path, "rb") as f:
        nodes, _, section = _segment_header(f.read(SEGMENT_HEADER_BYTES), os.fstat(f.fileno()).st_size)

    def pages_of(f, start, stop, pages):
        table = np.frombuffer(_at(f, section["nodes"][0] + start * SEGMENT_NODE.itemsize, pages * SEGMENT_NODE.itemsize), SEGMENT_NODE)

        def reader(name, starts, sizes):
            low, high = int(starts.min()), int((starts + sizes).max())
            if high - low <= 2 * int(sizes.sum()):
                held = memoryview(_at(f, section[name][0] + low, high - low))
                return lambda at, size: held[at - low : at - low + size]
            return lambda at, size: _at(f, section[name][0] + at, size)

        titles = reader("titles", table["title"], table["title_bytes"].astype("i8"))
        yield from _segment_records(table, titles, reader("out", 4 * table["out"], 4 * table["out_degree"].astype("i8")))

    return [(a, min(a + size, nodes), min(size, nodes - a)) for a in range(0, nodes, size)], pages_of


def read_buffer(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, parse_buffer, split_buffer)


def read_segment(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, parse_segment, split_segment)


def unpack(pages: DataFrame) -> Graph:
    """The graph of packed pages (id, title, is_redirect, links)."""
    return Graph(pages.select("id", "title", "is_redirect"), pages.select(F.col("id").alias("src"), F.explode("links").alias("dst")).distinct())


#: Rows of a chunk of bytes.
CHUNK_ROWS = 2_000
CHUNK = "task long, seq long, rows long, title_bytes long, links long, links_in long, bad long, a binary, b binary, c binary"


class _Chunks:
    """Sorted rows as stored chunks of bytes in their order; the driver holds a short row of sizes for each."""

    def __init__(self, rows: DataFrame, render):
        visible(rows.sparkSession)

        def run(batches):
            task, seq = TaskContext.get().partitionId(), 0
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK_ROWS):
                    columns = {"task": task, "seq": seq, "rows": min(CHUNK_ROWS, batch.num_rows - at), "title_bytes": 0, "links": 0, "links_in": 0, "bad": None, "a": b"", "b": b"", "c": b""}
                    columns |= render(batch.slice(at, CHUNK_ROWS))
                    yield pa.RecordBatch.from_arrays([pa.array([columns[n]], k) for n, k in kinds], [n for n, _ in kinds])
                    seq += 1

        kinds = [(n, pa.binary() if n in "abc" else pa.int64()) for n in (c.split()[0] for c in CHUNK.split(", "))]
        self.table = stored(rows.mapInArrow(run, CHUNK))
        sizes = self.table.select("task", "seq", "rows", "title_bytes", "links", "links_in", "bad", (F.length("a") + F.length("b") + F.length("c")).cast("long").alias("bytes")).toPandas().sort_values(["task", "seq"])
        self.bad = next((int(i) for i in sizes["bad"].dropna()), None)
        self.totals = {c: int(sizes[c].sum()) for c in ("rows", "title_bytes", "links", "links_in", "bytes")}
        before = {c: (sizes[c].cumsum() - sizes[c]).tolist() for c in self.totals}
        self.before = {place: dict(zip(before, own)) for place, own in zip(zip(sizes["task"].tolist(), sizes["seq"].tolist()), zip(*before.values()))}

    def put(self, path: str, pieces) -> None:
        """Writes ``pieces(chunk, before)``, (place, bytes) each, into the file; a task that is run again writes the same."""
        before = self.before

        def run(rows):
            with open(path, "r+b") as f:
                for row in rows:
                    for place, content in pieces(row, before[row.task, row.seq]):
                        f.seek(place)
                        f.write(content)
                f.flush()
                os.fsync(f.fileno())

        self.table.foreachPartition(run)


def _write(path: str, size: int, head: bytes, parts) -> None:
    """The file with its parts, (chunks, pieces) each, and at last its head; without it the file isn't readable.  Refuses to overwrite."""
    with open(path, "xb") as f:
        f.truncate(size)
    for chunks, pieces in parts:
        chunks.put(path, pieces)
    with open(path, "r+b") as f:
        f.write(head)
        f.flush()
        os.fsync(f.fileno())


def _check(graph: Graph, path: str) -> None:
    if os.path.exists(path):
        raise FileExistsError(path)
    most = (graph.nodes.agg(F.max("id")).first()[0] or 0, graph.edges.agg(F.max("dst")).first()[0] or 0)
    if max(most) > 2**31 - 1:
        raise ValueError("the format holds 32-bit ids only")


def _columns(batch):
    """Ids, flags, titles as bytes, counts of links, and all links of a batch of packed pages."""
    ids, flags = batch.column("id").to_numpy(), batch.column("is_redirect").to_numpy(zero_copy_only=False)
    titles, links = batch.column("title").cast(pa.binary()).to_pylist(), batch.column("links")
    return ids, flags, titles, np.diff(links.offsets.to_numpy()), links.flatten().to_numpy().astype("<i4")


def _buffer_chunk(batch) -> dict:
    ids, flags, titles, counts, links = _columns(batch)
    sizes, head = np.array([len(t) for t in titles]), BUFFER_RECORD.size
    bad = ids[(sizes > 32_767) | (counts > 32_767)]
    if len(bad):
        return {"bad": int(bad[0])}
    out, links = [], memoryview(links.tobytes())
    for i, flag, title, stop, n in zip(ids.tolist(), flags.tolist(), titles, accumulate(counts.tolist()), counts.tolist()):
        out += (BUFFER_RECORD.pack(-i if flag else i, n, head, len(title), head + 4 * n), links[4 * (stop - n) : 4 * stop], title)
    return {"a": b"".join(out)}


def write_buffer(graph: Graph, path: str) -> None:
    """A buffer file, pages in title order; refuses to overwrite, and pages beyond the format's 32,767 links or title bytes."""

    _check(graph, path)
    chunks = _Chunks(graph.pages().sort("title"), _buffer_chunk)
    if chunks.bad is not None:
        raise ValueError(f"page {chunks.bad} is too large for the format")
    head = BUFFER_HEADER.pack(BUFFER_MAGIC, chunks.totals["rows"])
    _write(path, len(head) + chunks.totals["bytes"], head, [(chunks, lambda row, before: [(len(head) + before["bytes"], row.a)])])
    discard(chunks.table)


def write_segment(graph: Graph, path: str) -> None:
    """A segment file: nodes in id order with their titles, edges both ways, and indexes by name and by id; needs a node at least."""
    before_of = lambda sizes: np.cumsum(sizes, dtype=np.int64) - sizes

    def nodes(batch):
        ids, flags, titles, counts, links = _columns(batch)
        table, sizes = np.zeros(len(ids), SEGMENT_NODE), np.array([len(t) for t in titles])
        table["id"], table["flags"], table["title_bytes"], table["out_degree"] = ids, np.where(flags, SEGMENT_REDIRECT, 0), sizes, counts
        table["in_degree"] = batch.column("links_in").to_numpy()
        table["title"] = before_of(sizes)
        for end in ("out", "in"):
            table[end] = before_of(table[f"{end}_degree"].astype("i8"))
        return {"title_bytes": int(sizes.sum()), "links": len(links), "links_in": int(table["in_degree"].sum()), "a": table.tobytes(), "b": b"".join(titles), "c": links.tobytes()}

    def sources(batch):
        return {"links_in": batch.num_rows, "a": batch.column("src").to_numpy().astype("<i4").tobytes()}

    def names(batch):
        titles = batch.column("title").cast(pa.binary()).to_pylist()
        table, sizes = np.zeros(len(titles), SEGMENT_NAME), np.array([len(t) for t in titles])
        table["key"], table["bytes"], table["id"] = before_of(sizes), sizes, batch.column("id").to_numpy()
        return {"title_bytes": int(sizes.sum()), "a": table.tobytes(), "b": b"".join(titles)}

    if graph.nodes.isEmpty():
        raise ValueError("the format has no empty graphs")
    _check(graph, path)
    ids = graph.nodes.select("id")
    if not graph.edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").isEmpty():
        raise ValueError("an edge leads to an id that is no node")
    incoming = graph.incoming.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    degrees = incoming.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("links_in"))
    by_id = _Chunks(graph.pages().join(degrees, "id", "left").withColumn("links_in", F.coalesce("links_in", F.lit(0))).sort("id"), nodes)
    ends = _Chunks(incoming.sort("dst", "src").select("src"), sources)
    by_name = _Chunks(graph.nodes.select("title", "id").sort("title", "id"), names)
    n, n_titles, n_links = (by_id.totals[c] for c in ("rows", "title_bytes", "links"))
    lengths = [n * SEGMENT_NODE.itemsize, n_titles, 4 * n_links, 4 * ends.totals["links_in"], n * SEGMENT_NAME.itemsize, n_titles, n * SEGMENT_ID.itemsize]
    starts = [SEGMENT_HEADER_BYTES + at for at in accumulate(lengths, initial=0)]
    at = dict(zip(SECTIONS, starts))

    def node_pieces(row, before):
        table, index = np.frombuffer(row.a, SEGMENT_NODE).copy(), np.zeros(row.rows, SEGMENT_ID)
        for column, of in (("title", "title_bytes"), ("out", "links"), ("in", "links_in")):
            table[column] += before[of]
        index["id"], index["rank"] = table["id"], np.arange(row.rows) + before["rows"]
        yield at["nodes"] + before["rows"] * SEGMENT_NODE.itemsize, table.tobytes()
        yield at["titles"] + before["title_bytes"], row.b
        yield at["out"] + 4 * before["links"], row.c
        yield at["ids"] + before["rows"] * SEGMENT_ID.itemsize, index.tobytes()

    def name_pieces(row, before):
        table = np.frombuffer(row.a, SEGMENT_NAME).copy()
        table["key"] += before["title_bytes"]
        yield at["names"] + before["rows"] * SEGMENT_NAME.itemsize, table.tobytes()
        yield at["name_keys"] + before["title_bytes"], row.b

    places = [x for place in zip(starts, lengths) for x in place]
    head = struct.pack("<qiiqqq14q", SEGMENT_MAGIC, SEGMENT_VERSION, 0, n, n_links, n_links, *places).ljust(SEGMENT_HEADER_BYTES, b"\0")
    parts = [(by_id, node_pieces), (ends, lambda row, before: [(at["in"] + 4 * before["links_in"], row.a)]), (by_name, name_pieces)]
    _write(path, starts[-1], head, parts)
    discard(*(chunks.table for chunks, _ in parts))
