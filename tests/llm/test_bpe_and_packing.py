"""op6 and op3 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagegraph.llm import bpe, packing, transducer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): np.array([i, i + 1][: 1 + i % 2], "<u4").tobytes() for i, w in enumerate(["tap", "taps", "top", "tops", "x", "ünd", "und"])}
    image = transducer.compile_lexicon(words)
    lexicon = transducer.Lexicon(image)
    assert lexicon.size == 7 and all(lexicon.find(w) == ids for w, ids in words.items())
    assert all(lexicon.find(w) is None for w in (b"", b"t", b"ta", b"tapss", b"topz", b"\xc3"))
    # ap(s) and op(s) share their ends: t -> {a, o} -> p -> s, with x and (ü|u)nd beside
    assert len(lexicon.finals) <= 9 + 3
    assert transducer.Lexicon(transducer.compile_lexicon({})).find(b"a") is None


def test_frequent_units_count_every_text(spark, nothing):
    """Units that every task meets once are as frequent as those that one task meets often."""
    texts = spark.createDataFrame([(f"x spread only{i}" + " often" * (30 if i == 7 else 0),) for i in range(40)], "text string").repartition(40)
    assert transducer.frequent_units(texts, 2) == [" often", " spread"]
    assert transducer.frequent_units(texts, 1) == [" spread"]
    assert len(transducer.frequent_units(texts, 42)) == 42
    assert transducer.frequent_units(nothing.select("text"), 5) == []


def test_encode_decode_is_exact(nasty, nothing, docs, tokenizer):
    for frame in (nasty, docs):
        got = sorted(transducer.encode_decode(frame, lexicon_size=50).collect(), key=str)
        want = []
        for r in frame.select("doc_id", "text").collect():
            ids = ids_of(tokenizer, r.text)
            want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
        assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got), key=str) == sorted(want, key=str)
    assert transducer.encode_decode(nothing).count() == 0


def test_query_digests(spark, sf_dir, docs, tokenizer):
    got = {r.doc_id: r for r in transducer.op6_bpe_transducer(spark, sf_dir).collect()}
    for r in docs.collect():
        ids = ids_of(tokenizer, r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def check_packed(rows, frame, tokenizer, capacity=2048):
    want = []
    for r in frame.select("doc_id", "text").collect():
        ids = ids_of(tokenizer, r.text) + [0]
        first = len(ids) - (len(ids) - 1) // capacity * capacity
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
            want.append((r.doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(w[3] for w in want) // capacity)


def test_packing(spark, sf_dir, nasty, nothing, docs, tokenizer):
    check_packed(packing.pack(nasty.repartition(5)).collect(), nasty, tokenizer)
    used, least = check_packed(packing.op3_best_fit_packing(spark, sf_dir).collect(), docs, tokenizer)
    assert used <= least + 2
    # many tasks, few pieces each: the tree merges what they leave
    used, least = check_packed(packing.pack(docs.repartition(40), fan_in=3).collect(), docs, tokenizer)
    assert used <= least + 4
    assert packing.pack(nothing).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins = packing.best_fit([(7, ["a"]), (5, ["b"]), (3, ["c"]), (5, ["d"]), (10, ["e"])], 10)
    assert sorted((used, sorted(held)) for used, held in bins) == [(10, ["a", "c"]), (10, ["b", "d"]), (10, ["e"])]


def test_lengths_apart_still_meet(spark, tokenizer):
    # one task has 1,200-token documents only, the other 840-token ones, each more pieces than it may carry
    rows = [(i, " a" * (1199 if i < 60 else 839)) for i in range(120)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    used, _ = check_packed(packing.pack(frame, carry=16).collect(), frame, tokenizer)
    assert used == 60  # 1,200 + 840 each


def test_placing_a_histogram_is_best_fit():
    rng = random.Random(3)
    for capacity in (10, 64, 500):
        counts = {s: rng.randint(1, 40) for s in rng.sample(range(1, capacity + 1), capacity // 2)}
        n_bins, steps = packing.place(counts, capacity)
        assert n_bins == len(packing.best_fit([(s, [None]) for s, n in counts.items() for _ in range(n)], capacity))
        assert min(counts.values()) > 0 and all(o + e * s <= capacity for s, _, e, _, o in steps)


def test_tasks_and_carry_hardly_change_the_number_of_sequences(docs):
    found = []
    for tasks, carry in ((1, 2_048), (24, 2_048), (24, 16)):
        rows = packing.pack(docs.repartition(tasks), carry=carry).collect()
        least = -(-sum(r.length for r in rows) // 2048)
        found.append((len({r.sequence_id for r in rows}), least))
    assert all(n <= 1.01 * least + 1 for n, least in found), found
