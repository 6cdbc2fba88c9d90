"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The most frequent text units of the corpus, with their ids as output, are compiled into
one automaton in which equal suffixes are shared (the minimal acyclic automaton of the
sorted words).  A transition knows how many words are left of it, so a walk ends with the
word's rank, which leads to its ids.  Workers map the compiled image into memory.  Units
that the lexicon lacks are merged exactly, and ids are decoded through the vocabulary.

The lexicon holds the units whose count over all texts reaches a threshold that a histogram
of the counts gives, so no more than ``lexicon_size`` of them come to the driver.  It only
decides which way a unit is encoded, never its ids.

Edge cases: null and empty texts have no ids; special tokens inside a text get their own
id, as the tokenizers library does it; repeated rows give repeated results; an empty table
gives an empty result; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import mmap
import struct
import tempfile
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import UnitEncoder
from .lm import rank_of, threshold

MAGIC = b"MATL0001"


def compile_lexicon(words: dict[bytes, bytes]) -> bytes:
    """The memory image of the minimal acyclic transducer of ``words`` (word -> packed ids).

    States are built from sorted words one after another: what follows the common prefix
    with the next word is finished, and a finished state is replaced by its equal, if any.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (is_final, ((label, target), ...)) of finished states
    order = sorted(words)

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append(key)
        return at

    path: list[list] = [[False, []]]
    last = b""
    for word in order:
        common_length = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        for depth in range(len(last), common_length, -1):
            path[depth - 1][1].append((last[depth - 1], finish(path.pop())))
        path += [[False, []] for _ in range(len(word) - common_length)]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], finish(path.pop())))
    root = finish(path[0])

    below = array("I", bytes(4 * len(states)))  # words at or below a state; targets are finished before their sources
    for i, (final, edges) in enumerate(states):
        below[i] = final + sum(below[t] for _, t in edges)
    first, labels, targets, skips = array("I", [0]), bytearray(), array("I"), array("I")
    for final, edges in states:
        skip = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(skip)
            skip += below[target]
        first.append(len(labels))
    finals = bytes(final for final, _ in states)
    ends = np.cumsum([0, *(len(words[w]) // 4 for w in order)], dtype=np.uint32)
    parts = [finals, bytes(labels), first.tobytes(), targets.tobytes(), skips.tobytes(), ends.tobytes(), b"".join(words[w] for w in order)]
    parts = [p + bytes(-len(p) % 4) for p in parts]
    return MAGIC + struct.pack("<9I", root, len(order), *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled lexicon, mapped from an unlinked file of this process."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a lexicon image")
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, self.size, *sizes = struct.unpack_from("<9I", self.map, 8)
        at, view, parts = 8 + 36, memoryview(self.map), []
        for n in sizes:
            parts.append(view[at : at + n])
            at += n
        self.finals, self.labels = parts[:2]
        self.first, self.targets, self.skips, self.ends = (p.cast("I") for p in parts[2:6])
        self.ids = parts[6]

    def find(self, word: bytes) -> bytes | None:
        """The packed ids of ``word``, or None if the lexicon lacks it."""
        state, rank, first, labels = self.root, 0, self.first, self.labels
        for byte in word:
            low, high = first[state], first[state + 1]
            while low < high:  # labels of a state ascend
                middle = (low + high) // 2
                if labels[middle] < byte:
                    low = middle + 1
                else:
                    high = middle
            if low == first[state + 1] or labels[low] != byte:
                return None
            rank += self.skips[low]
            state = self.targets[low]
        if not self.finals[state]:
            return None
        return bytes(self.ids[4 * self.ends[rank] : 4 * self.ends[rank + 1]])


def frequent_units(texts: DataFrame, most: int) -> list[str]:
    """The most frequent blank-separated units of all texts, with their leading blank, in order: ``most`` at most, units of one step of counts together."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for _, some in common.slices(batch.column(0), 512):
                for text in some:
                    seen.update((text or "").split(" ")[1:])
            if len(seen) > 1_000_000:
                yield from emit(seen)
                seen.clear()
        yield from emit(seen)

    def emit(seen):
        kept = [(u, n) for u, n in seen.items() if u and not u[0].isspace() and not u[-1].isspace() and len(u) <= 64]
        for at in range(0, len(kept), 50_000):
            units, counts = zip(*kept[at : at + 50_000])
            yield pa.RecordBatch.from_pydict({"unit": pa.array(units), "n": pa.array(counts, pa.int64())})

    counted = common.stored(texts.mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")))
    top = counted.where(rank_of("n") >= threshold(counted, most)).select("unit").toArrow().column(0).to_pylist()
    common.discard(counted)
    return sorted(" " + u for u in top)


def encode_decode(docs: DataFrame, *, vocab_path: str | None = None, lexicon_size: int = 32_768) -> DataFrame:
    """Encodes every text of ``docs(doc_id, text)`` and decodes the ids again.

    Returns doc_id, n_tokens, ids (packed, unsigned 32-bit little-endian) and decoded text.
    """
    common.visible(docs.sparkSession)
    plain = UnitEncoder(vocab_path)
    image = compile_lexicon({u.encode(): plain.merge(u) for u in frequent_units(docs.select("text"), lexicon_size)})
    shared = docs.sparkSession.sparkContext.broadcast(image)

    def run(batches):
        lexicon = Lexicon(shared.value)

        def unit(text: str) -> bytes:
            found = lexicon.find(text.encode())
            return encoder.merge(text) if found is None else found

        encoder = UnitEncoder(vocab_path, unit)
        for batch in batches:
            ids = batch.column(0)
            for at, texts in common.slices(batch.column(1), 512):
                packed = [encoder.encode(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array([encoder.decode(p) for p in packed], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
