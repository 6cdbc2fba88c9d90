"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct word shingles, hashed to 64 bits.  Documents with
one and the same set form a class and are represented by their smallest doc_id.

1. Classes are partitioned into groups of similar sets: a class joins the group of its
   smallest token hash (among hot tokens, if they are half of its set) and of its band of
   sizes, and larger groups are cut into blocks of ``block`` members.
   For prefixes tokens are ordered by (heat, hash), rarest first, so tokens of widespread
   passages come last.  Heat is how far a sketch of fixed size counts a token above its
   mean, in powers of two, 0 for all that don't stand out; it only speeds things up, since
   prefixes by any order are exact.
2. The token-group matrix has an entry for each token and each group whose union of
   prefixes holds it.  If |A n B| >= t |A u B|, the prefixes of A and B, |X| - ceil(t |X|)
   + k_X tokens long, share min(k_A, k_B) tokens at least.  So joining the classes with
   the matrix and counting bounds the overlap of a class with each group; groups below
   the bound, and groups of sizes that no set of the class's size links to, are never
   opened.  Tokens without heat are few each, so one exchange finds those that only one
   class has; hot ones are taken to have company.
3. Opened groups get the full sets: the union of the members' sets bounds the overlap
   once more, then members are verified exactly, leaving out pairs that are linked
   already.  A task holds the members of one block and at most about ``queries`` callers.
4. The links found, a spanning forest of each neighbourhood, make up the components.

Edge cases: null and empty texts, and texts of blanks, have an empty set and no links;
fewer words than a shingle make one shingle; rows that repeat a doc_id are one node, with
the links of all of them; rows with a null doc_id are counted but linked with nothing and
have a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
BITS = 1 << 24


class Codes(dict):
    """Word -> 64-bit hash; a cache of a stated size."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = code
        return code


class Shingler:
    """Text -> its ascending distinct shingle hashes.  Words are runs of bytes other than blank and tab to carriage return; A-Z is lower-cased."""

    def __init__(self, width: int):
        self.width, self.codes = width, Codes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        code = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(code))
        if not width:
            return code
        h = np.full(len(code) - width + 1, width, np.uint64)
        for j in range(width):
            h = h * MIX + code[j : len(code) - width + 1 + j]
        h ^= h >> np.uint64(29)
        h *= MIX2
        h ^= h >> np.uint64(32)
        return np.unique(h)


def required(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any set it links to."""
    return -(-percent * n // 100)


def slack(n: int) -> int:
    """How many prefix tokens a set of ``n`` shares at least with any set it links to, if that one's slack isn't less."""
    return 1 + n // 25


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Forest:
    """Union-find whose unions are the links to report."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x: int, y: int) -> None:
        self.parent[self.root(x)] = self.root(y)
        self.links.append((max(x, y), min(x, y)))


def open_group(members: list, callers: list, percent: int, inside: bool) -> list[tuple[int, int]]:
    """Verified links of a group's members (``inside``: also among themselves) with its callers, each (doc_id, set)."""
    forest = Forest()
    if inside:
        for i, (a, x) in enumerate(members):
            for b, y in members[:i]:
                if forest.root(a) != forest.root(b) and linked(x, y, percent):
                    forest.link(a, b)
    if callers and members:
        union = np.unique(np.concatenate([x for _, x in members]))
        for q, x in callers:
            at = np.searchsorted(union, x)
            at[at == len(union)] = 0
            if int((union[at] == x).sum()) < required(len(x), percent):
                continue
            for a, y in members:
                if forest.root(a) != forest.root(q) and linked(x, y, percent):
                    forest.link(q, a)
    return forest.links


def describe(docs: DataFrame, width: int) -> DataFrame:
    """A row (doc_id, n, d1, d2) per document: set size and 128-bit digest; and for each task its part of the token sketch (task, chunk, counts)."""

    def run(batches):
        shingle, seen, held, total = Shingler(width), set(), [], 0
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)

        def count():
            place, n = np.unique(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
            sketch[place.astype(np.int64)] += n.astype(np.uint32)

        for batch in batches:
            ids = batch.column(0)
            for at, texts in common.slices(batch.column(1), 512):
                n, d1, d2 = [], [], []
                for text in texts:
                    h = shingle(text)
                    digest = xxhash.xxh3_128_digest(h.tobytes())
                    if digest not in seen:
                        seen.add(digest)
                        held.append(h)
                        total += len(h)
                    n.append(len(h))
                    d1.append(int.from_bytes(digest[:8], "little", signed=True))
                    d2.append(int.from_bytes(digest[8:], "little", signed=True))
                rows = len(n)
                yield pa.RecordBatch.from_arrays([ids.slice(at, rows), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], NAMES)
                if total > 1_000_000:
                    count()
                    held, total = [], 0
                    if len(seen) > 1_000_000:
                        seen = set()
        if held:
            count()
        task = TaskContext.get().partitionId()
        for chunk, counts in enumerate(sketch.reshape(CHUNKS, -1)):
            if counts.any():
                one = lambda x, kind: pa.array([x], kind)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), one(task, pa.int64()), one(chunk, pa.int32()), one(packed(counts), pa.binary())], NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, task long, chunk int, counts binary")


NAMES = ["doc_id", "n", "d1", "d2", "task", "chunk", "counts"]
SKETCH_BITS, CHUNKS, SPREAD = 23, 64, 64
COPIES = 256  # keys over which the copies of one text are spread


def packed(counts: np.ndarray) -> bytes:
    """A chunk of the sketch, mostly zeros in one task: which counters aren't, a bit each, then those."""
    some = counts > 0
    return zlib.compress(np.packbits(some).tobytes() + counts[some].tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    size = (1 << SKETCH_BITS) // CHUNKS
    raw, counts = np.frombuffer(zlib.decompress(data), np.uint8), np.zeros(size, np.uint32)
    counts[np.unpackbits(raw[: size // 8]).astype(bool)] = raw[size // 8 :].view(np.uint32)
    return counts


def heat_map(parts: DataFrame, fan_in: int = 256) -> np.ndarray:
    """The heat of each counter of the sketch, a byte each, so of fixed size; sketches are added up ``fan_in`` tasks at a time."""

    def add(rows: pa.Table) -> np.ndarray:
        total = np.zeros((1 << SKETCH_BITS) // CHUNKS, np.uint64)
        for counts in rows.column("counts"):
            total += unpacked(counts.as_buffer())
        return np.minimum(total, 2**32 - 1).astype(np.uint32)

    def merge(rows: pa.Table) -> pa.Table:
        return pa.table({"chunk": rows.column("chunk")[:1], "counts": pa.array([packed(add(rows))], pa.binary())})

    def mark(rows: pa.Table) -> pa.Table:
        counts = add(rows)
        mean = float(counts.mean())
        most = mean + 6 * mean**0.5 + 4
        heat = np.where(counts > most, 1 + np.log2(np.maximum(counts, most) / most), 0).astype(np.uint8)
        return pa.table({"chunk": rows.column("chunk")[:1], "counts": pa.array([zlib.compress(heat.tobytes(), 1)], pa.binary())})

    parts = parts.select("chunk", F.expr(f"div(task, {fan_in})").alias("part"), "counts")
    merged = parts.groupBy("chunk", "part").applyInArrow(merge, "chunk int, counts binary")
    heat = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.uint8)
    for r in merged.groupBy("chunk").applyInArrow(mark, "chunk int, counts binary").collect():  # a row a chunk
        heat[r.chunk] = np.frombuffer(zlib.decompress(r.counts), np.uint8)
    return heat.ravel()


def prefixes(docs: DataFrame, width: int, percent: int, heat: np.ndarray) -> DataFrame:
    """(doc_id, n, head, cold, hot): the smallest token and the prefix in the global order of each document, without and with heat; a task leaves out copies with a larger doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(heat.tobytes(), 1))

    def lists(tokens):
        ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))

    def run(batches):
        shingle, heat, seen = Shingler(width), np.frombuffer(zlib.decompress(shared.value), np.uint8), {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in common.slices(batch.column(1), 512):
                doc, size, head, cold, hot = [], [], [], [], []
                for i, text in zip(ids[at:], texts):
                    h = shingle(text)
                    if i is None or not len(h):
                        continue
                    digest = xxhash.xxh3_128_digest(h.tobytes())
                    if seen.get(digest, i + 1) <= i:
                        continue
                    seen[digest] = i
                    if len(seen) > 1_000_000:
                        seen = {}
                    doc.append(i)
                    size.append(len(h))
                    length = len(h) - required(len(h), percent) + slack(len(h))
                    own = heat[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    warm = np.flatnonzero(own)
                    # what copies of a widespread text add of their own is never hot, so their head is a token that they share
                    head.append(as_long(h[warm] if 2 * len(warm) >= len(h) else h)[0])
                    cold.append(as_long(h[own == 0][:length]))
                    hot.append(as_long(h[warm[np.argsort(own[warm], kind="stable")]][: max(0, length - len(cold[-1]))]))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(head, pa.int64()), lists(cold), lists(hot)], ["doc_id", "n", "head", "cold", "hot"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, head long, cold array<long>, hot array<long>")


def full_sets(docs: DataFrame, width: int, needed: DataFrame) -> DataFrame:
    """(doc_id, tokens as bytes) of the documents that may be in ``needed(doc_id)``: a bit map of fixed size leaves out most others before their sets are moved."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    words = needed.select(place.cast("int").alias("p")).selectExpr("cast(div(p, 32) as int) as w", "shiftleft(1L, p % 32) as b").groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(BITS // 32, np.int64)  # at most as many rows as words
    for r in words.toLocalIterator():
        bits[r.w] = r.b
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        shingle, bits = Shingler(width), shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at // 32] >> (at % 32) & 1).astype(bool)))
            for start, texts in common.slices(batch.column(1), 512):
                sets = [shingle(t).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return docs.where("doc_id is not null").select("doc_id", "text", place.alias("place")).mapInArrow(run, "doc_id long, set binary")


def similar(docs: DataFrame, *, width: int = 4, percent: int = 85, block: int = 128, queries: int = 1_024) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs(doc_id, text)``; sets link if 100 |A n B| >= percent |A u B|."""
    common.visible(docs.sparkSession)
    told = common.stored(describe(docs, width))
    heat = heat_map(told.where("chunk is not null").select("task", "chunk", "counts"))
    seen = told.where("chunk is null").select("doc_id", "n", "d1", "d2")
    # the copies of one text are spread over ``COPIES`` keys: each key's least row, then the least of a class
    seen = seen.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)))
    few = common.stored(seen.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "at").agg(F.min("doc_id").alias("least")))
    classes = few.groupBy("d1", "d2").agg(F.min("least").alias("rep"))
    classes = few.select("d1", "d2", "at").join(classes, ["d1", "d2"])
    named = seen.join(classes, ["d1", "d2", "at"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    named = common.stored(named)
    common.discard(told, few)

    # groups; a head of many members is spread over ``SPREAD`` keys before it is looked up
    # only rows that may be copies of another document are held against the representatives; the other prefixes stay where they are
    reps = named.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    every = common.stored(common.marked(prefixes(docs, width, percent, heat), named.where("rep <> doc_id").select("doc_id"), "doc_id").select("row.*", "maybe"))
    few = common.stored(every.where("maybe").drop("maybe").join(reps, "doc_id", "left_semi"))
    prefix = every.where("not maybe").drop("maybe").unionByName(few)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1.25))).cast("int")
    headed = prefix.select("doc_id", "n", "head", band.alias("band"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SPREAD)).cast("int").alias("at"))
    large = headed.groupBy("head", "band").count().where(F.col("count") > block).select("head", "band", F.ceil(F.col("count") / block).alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("at"))
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1)))
    slack_of = (F.lit(1) + F.expr("div(n, 25)")).cast("int")
    members = headed.join(large, ["head", "band", "at"], "left").select("doc_id", "n", slack_of.alias("k"), F.xxhash64("head", "band", part).alias("gid"))

    # matrix and bound; a class that shares too few tokens with all others together has no links
    cold = prefix.select("doc_id", F.explode("cold").alias("token")).repartition("token")
    cold = cold.withColumn("several", F.count("*").over(Window.partitionBy("token"))).where("several > 1")
    posting = common.stored(cold.select("doc_id", "token").unionByName(prefix.select("doc_id", F.explode("hot").alias("token"))))
    shared = posting.groupBy("doc_id").agg(F.count("*").alias("shared"))
    enough = F.expr(f"shared >= 1 + div(div(n * {percent} + 99, 100), 25)")
    members = common.stored(members.join(shared, "doc_id").where(enough).select("doc_id", "n", "k", "gid"))
    common.discard(every, few)
    every, posting = posting, common.stored(common.members_of(posting, members, "doc_id").join(members, "doc_id"))
    common.discard(every)
    matrix = posting.groupBy("token", "gid").agg(F.min("k").alias("least"), F.min("n").alias("low"), F.max("n").alias("high")).withColumnRenamed("gid", "target")
    # of two groups the one with the larger number calls, if sizes allow a link
    near = F.expr(f"target < gid and 100 * n >= {percent} * low and 100 * high >= {percent} * n")
    met = posting.join(matrix, "token").where(near).groupBy("doc_id", "target").agg(F.count("*").alias("met"), F.min(F.least("k", "least")).alias("bound"))
    calls = common.stored(met.where("met >= bound").select("doc_id", F.col("target").alias("gid")))
    common.discard(posting)

    # opened groups
    opened = calls.groupBy("gid").agg(F.ceil(F.count("*") / queries).cast("int").alias("parts"))
    sized = members.groupBy("gid").agg(F.count("*").alias("own")).join(opened, "gid", "left").where("own > 1 or parts is not null").select("gid", F.coalesce("parts", F.lit(1)).alias("parts"))
    as_member = members.join(sized, "gid").select("doc_id", "gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("inner"))
    as_caller = calls.join(sized, "gid").select("doc_id", "gid", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), F.lit(False).alias("inner"))
    roles = common.stored(as_member.unionByName(as_caller))
    common.discard(members, calls)
    sets = full_sets(docs, width, roles.select("doc_id"))

    def verify(rows: pa.Table) -> pa.Table:
        inner, ids = rows.column("inner").to_pylist(), rows.column("doc_id").to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
        order = sorted(range(len(ids)), key=ids.__getitem__)
        pick = lambda role: [(ids[i], sets[i]) for i in order if inner[i] is role]
        links = open_group(pick(True), pick(False), percent, rows.column("part")[0].as_py() == 0)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*links) if links else ((), ()))], names=["a", "b"])

    links = roles.join(sets, "doc_id").groupBy("gid", "part").applyInArrow(verify, "a long, b long")
    several = named.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b <> most").select("doc_id", "b")
    repeated = named.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    found = components(links.unionByName(repeated))
    out = named.join(found, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs``, all columns, with one document of each component, the one with the smallest doc_id; documents without shingles or doc_id stay."""
    found = common.stored(similar(docs, **how).where("doc_id is not null and n_shingles > 0"))
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    # texts that stay aren't moved, but for the few that the bit map can't tell from those that go
    sure, open_ = common.parted(docs, gone, "doc_id")
    kept = sure.unionByName(open_.join(gone, "doc_id", "left_anti").select(*docs.columns))
    again = found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    # rows that repeat a doc_id: the one whose text comes last, which is never an empty one
    sure, open_ = common.parted(kept, again, "doc_id")
    rows = open_.join(again, "doc_id", "left_semi").select("doc_id", F.struct(*kept.columns).alias("row"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("row.text")))).where("at = 1").select("row.*")
    return sure.unionByName(open_.join(again, "doc_id", "left_anti").select(*docs.columns)).unionByName(rows.select(*docs.columns))


def op7_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(common.table(spark, sf_dir, "documents"))
