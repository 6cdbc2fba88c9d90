"""Best-fit packing by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens.  Every task best-fits its own
pieces into bins, largest first, and emits the nearly full ones for good.  The pieces of
the underfull bins travel on: each round merges those of ``fan_in`` tasks and best-fits
them again.  A task that would pass on more than ``carry`` pieces keeps them for the last
round instead, so no task ever holds more than ``window`` pieces or ``fan_in * carry``,
however large the input is.

The last round takes all pieces that lie in no nearly full bin, whichever task they come
from.  It best-fits their histogram, ``capacity`` counts at most: a step of ``place`` puts
all pieces of a run of ranks within their length into a run of bins.  A piece finds its bin
and offset by its rank, so no task holds the pieces and no underfull bin is final before.

Edge cases: a null or empty text is a document of the one closing id; repeated rows
are packed once each; pieces that tie in length go in the order they are met, which changes
places but not the number of sequences of the last round; texts of any length are cut into
pieces; columns other than doc_id and text are left out, whatever their names; an empty
table gives an empty result; a null doc_id is kept.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .bpe import UnitEncoder

MEMBER = "struct<doc_id:bigint,piece:bigint,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
BIN = f"used long, state int, at long, members array<{MEMBER}>"
OPEN, FULL, LATE = range(3)  # for the next round, for good, for the last round


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; only the first may be shorter than ``capacity``."""
    head = n - (n - 1) // capacity * capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def best_fit(items: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Best-fit decreasing over (size, members): each item goes to the bin with the least room that still holds it.

    Open bins lie in one list for each amount of room, and a bit mask finds the
    smallest sufficient room, so an item costs the same however many bins are open.
    """
    room: list[list] = [[] for _ in range(capacity + 1)]
    mask, full = 0, []
    for size, members in sorted(items, key=lambda x: -x[0]):
        fit = mask >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            held = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            held += members
        else:
            free, held = capacity, list(members)
        free -= size
        if free:
            room[free].append(held)
            mask |= 1 << free
        else:
            full.append((capacity, held))
    return full + [(capacity - free, held) for free in range(1, capacity + 1) for held in room[free]]


def place(counts: dict[int, int], capacity: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Best-fit decreasing over so many pieces of each length: the number of bins, and steps (length, rank, each, bin, offset).

    A step puts the pieces of that length from that rank on, ``each`` to a bin, into the
    bins from ``bin`` on, where they start at ``offset``.  Bins alike are one run, so the
    steps are few however many pieces there are.
    """
    room: list[list] = [[] for _ in range(capacity + 1)]
    mask, n_bins, steps = 0, 0, []

    def put(free, run):
        nonlocal mask
        room[free].append(run)
        mask |= 1 << free

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            fit = mask >> size
            if not fit:
                new = -(-left // (capacity // size))
                put(capacity, (n_bins, new))
                n_bins, fit = n_bins + new, mask >> size
            free = size + (fit & -fit).bit_length() - 1
            first, n = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            each = min(free // size, left)
            taken = min(n, left // each)
            steps.append((size, rank, each, first, capacity - free))
            if taken < n:
                put(free, (first + taken, n - taken))
            if free > each * size:
                put(free - each * size, (first, taken))
            rank, left = rank + taken * each, left - taken * each
    return n_bins, steps


def settle(bins: list[tuple[int, list]], full_from: int, carry: int, last: bool = False) -> list[tuple[int, int, list]]:
    """(used, state, members): the nearly full bins for good, and the pieces of the others.

    ``carry`` pieces or fewer go on to the next round, each as a bin of its own.  More, and
    all after the last merge, go to the last round, those of equal length together.
    """
    full = [(used, FULL, held) for used, held in bins if used >= full_from]
    pieces = [m for used, held in bins if used < full_from for m in held]
    if len(pieces) <= carry and not last:
        return full + [(m[3], OPEN, [m]) for m in pieces]
    late = defaultdict(list)
    for m in pieces:
        late[m[3]].append(m)
    return full + [(length, LATE, held) for length, held in late.items()]


def _batch(bins: list[tuple[int, int, list]], at: int):
    """Batches of ``bins``; ``at`` tells one such call from all others of its round."""
    for i in range(0, len(bins), 2000):
        used, state, members = zip(*bins[i : i + 2000])
        placed = [[dict(zip(KEYS, (*m[:5], offset))) for m, offset in zip(held, accumulate((m[3] for m in held), initial=0))] for held in members]
        yield pa.RecordBatch.from_pydict({"used": used, "state": state, "at": [at] * len(used), "members": placed}, schema=SCHEMA)


KEYS = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
SCHEMA = pa.schema([("used", pa.int64()), ("state", pa.int32()), ("at", pa.int64()), ("members", pa.list_(pa.struct([(k, pa.int64()) for k in KEYS])))])


def pack(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, vocab_path: str | None = None, full_share: float = 0.995, fan_in: int = 8, carry: int = 2_048, window: int = 100_000) -> DataFrame:
    """Packs ``docs(doc_id, text)``; returns one row per piece with its sequence and offset.

    ``ids_crc32`` is the crc32 of the piece's ids, unsigned 32-bit little-endian.
    """
    common.visible(docs.sparkSession)
    full_from, end = int(capacity * full_share), end_id.to_bytes(4, "little")

    def local(batches):
        encoder, items, at = UnitEncoder(vocab_path), [], TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, texts in common.slices(batch.column(1), 256):
                for doc, text in zip(ids[i:], texts):
                    packed = encoder.encode(text or "") + end
                    for piece, (start, length) in enumerate(cut(len(packed) // 4, capacity)):
                        items.append((length, [(doc, piece, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]))]))
                if len(items) >= window:
                    yield from _batch(settle(best_fit(items, capacity), full_from, carry), at)
                    items, at = [], at + 1
        yield from _batch(settle(best_fit(items, capacity), full_from, carry), at)

    def merge(last: bool):
        def run(batches):
            items, at = [], TaskContext.get().partitionId() << 32
            for batch in batches:
                for used, members in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                    items.append((used, [tuple(m.values()) for m in members]))
                if len(items) >= window:
                    yield from _batch(settle(best_fit(items, capacity), full_from, carry, last), at)
                    items, at = [], at + 1
            yield from _batch(settle(best_fit(items, capacity), full_from, carry, last), at)

        return run

    bins = common.checkpoint(docs.select("doc_id", "text").mapInArrow(local, BIN))
    tasks, rounds = bins.rdd.getNumPartitions(), [bins]
    while True:
        tasks = max(1, -(-tasks // fan_in))
        bins = common.checkpoint(bins.where(f"state = {OPEN}").coalesce(tasks).mapInArrow(merge(tasks == 1), BIN))
        rounds.append(bins)
        if tasks == 1:
            break
    full, late = None, None
    for k, bins in enumerate(rounds):
        done, rest = bins.where(f"state = {FULL}"), bins.where(f"state = {LATE}").withColumn("round", F.lit(k))
        full, late = (full.unionByName(done), late.unionByName(rest)) if k else (done, rest)

    # the last round
    n_bins, steps = place({r.used: r.n for r in late.groupBy("used").agg(F.sum(F.size("members")).alias("n")).collect()}, capacity)  # a row for each length at most
    steps = docs.sparkSession.sparkContext.broadcast(np.array(sorted(steps), np.int64).reshape(-1, 5))

    def assign(batches):
        size, rank, each, first, offset = steps.value.T
        for batch in batches:
            mine, length = batch.column(5).to_numpy(), batch.column(3).to_numpy()
            step = np.searchsorted((size << 40) + rank, (length << 40) + mine, "right") - 1
            past = mine - rank[step]
            columns = [*batch.columns[:5], pa.array(first[step] + past // each[step]), pa.array(offset[step] + past % each[step] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    key = ["used", "round", "at"]
    before = F.coalesce(F.sum("n").over(W.partitionBy("used").orderBy("round", "at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = late.select(*key, F.size("members").alias("n")).select(*key, before.alias("before"))
    ranked = late.join(ranks, key).select("before", F.posexplode("members").alias("pos", "m"))
    ranked = ranked.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", (F.col("before") + F.col("pos")).alias("rank"))
    placed = ranked.mapInArrow(assign, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = full.withColumn("sequence_id", F.monotonically_increasing_id() + n_bins).select("sequence_id", F.explode("members").alias("m"))
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return full.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset").unionByName(placed.select(*columns))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
