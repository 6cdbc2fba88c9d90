"""Language-model scores by subword lattice likelihood.

A word is a path through the lattice of all its segmentations into pieces of an existing
vocabulary; its probability is the sum over the paths, computed by the forward recursion
in log space.  The vocabulary's own scores give the pieces' first weights, and a few
rounds of expectation-maximisation over all distinct training words fit them, with the
first weights as prior.  A first piece is drawn from those that begin a word, later ones
from the rest and the word's end, so the lattice is a distribution over words.

On top, a lattice arc for each word known from training carries its discounted share of
the training tokens, and the mass set free by the discount goes to the subword arcs:
P(w) = max(c - D, 0) / N + (D V / N) lattice(w).  Each of the most frequent values of
``class_column`` among training documents has counts and a lattice of its own:
P_k(w) = max(c_k - D, 0) / N_k + (D V_k / N_k) (0.9 lattice_k(w) + 0.1 G(w)), where G is
the discounted share over all classes, brought to 1.  All these sum to 1 over all words.
A document's class isn't read when it is scored: its probability is the marginal over the
classes, log10 of the sum over k of prior_k times the product of P_k over the words and
the end.  One class more, of a tenth of the prior, stands for documents of any class.

Counts and statistics come from all training documents, weights from all distinct words
of each class; those of documents outside the most frequent classes are learned from for
the lattice of any class.  What is broadcast is bounded: the weights of the pieces, and the words
whose count reaches a threshold that a histogram gives, ``most_frequent`` at most.  All
other words are scored by a join with the word table, with the same sums, so the bound
changes no score.

Edge cases: a null or empty text is its end alone; without training documents N is 0 and
the lattice alone scores; repeated rows are scored and counted once each; a null doc_id
counts as the empty text for its fold; words of any length are scored and learned from;
ties among classes of equal size go by name; columns other than doc_id, text and the
class are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

START = 0xFFFFFFFF  # stands before a word, where pieces of the vocabulary have their mark
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
NEVER = -math.inf


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """(pieces as code-point tuples, their first log weights, byte weights): weights fall with the rank that the vocabulary's scores give."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or MARK in piece[1:]:
            continue
        codes = (START, *map(ord, piece[1:])) if piece[0] == MARK else tuple(map(ord, piece))
        found[codes] = 1 / (50 - score)
    found.setdefault((START,), 1e-3)
    pieces = sorted(found)
    begins = np.array([p[0] == START for p in pieces])
    weight = np.array([found[p] for p in pieces])
    share = np.where(begins, weight / weight[begins].sum(), 0.85 * weight / weight[~begins].sum())
    return pieces, begins, share  # of later pieces 0.85; the word's end 0.1; bytes 0.05


def log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high)) if low > NEVER else high


class Lattice:
    """Forward and forward-backward recursions over many words at once."""

    BYTE = math.log(0.05 / 256)

    def __init__(self, path: str, share: np.ndarray | None = None, end: float = 0.1):
        self.pieces, self.begins, first = vocabulary(path)
        self.weigh(first if share is None else share, end)
        self.longest = max(map(len, self.pieces))
        self.powers = np.cumprod(np.array([1, *[int(BASE)] * self.longest], np.uint64))
        self.table = dict(zip(self.pieces, range(len(self.pieces))))
        keys = np.array([self.key(p) for p in self.pieces], np.uint64)
        # two hash tables: what collides in the first goes to the second, and what collides there to a sorted rest
        self.size = 18
        self.slots, rest = [], np.arange(len(keys))
        for shift in (0, 21):
            slot = np.full(1 << self.size, -1, np.int64)
            place = self.place(keys[rest], shift)
            slot[place[::-1]] = rest[::-1]
            rest = rest[slot[place] != rest]
            self.slots.append(slot)
        self.keys = np.concatenate([keys, [np.uint64(0)]])
        self.rest = rest[np.argsort(keys[rest])]

    def weigh(self, share: np.ndarray, end: float) -> None:
        """Takes other weights for the same pieces."""
        self.logp, self.end = np.log(np.maximum(share, 1e-300)), math.log(end)

    def reweighed(self, share: np.ndarray, end: float) -> Lattice:
        """A lattice of the same tables with other weights."""
        other = copy(self)
        other.weigh(share, end)
        return other

    def key(self, codes) -> int:
        h = 0
        for c in codes:
            h = (h * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def place(self, keys: np.ndarray, shift: int) -> np.ndarray:
        return ((keys * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.size - shift) & np.uint64((1 << self.size) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The pieces' numbers, -1 where there is none."""
        out = self.slots[0][self.place(keys, 0)]
        out[self.keys[out] != keys] = -1
        miss = np.flatnonzero(out < 0)
        second = self.slots[1][self.place(keys[miss], 21)]
        good = self.keys[second] == keys[miss]
        good &= second >= 0
        out[miss[good]] = second[good]
        if len(self.rest):
            miss = miss[~good]
            at = np.searchsorted(self.keys[self.rest], keys[miss])
            at[at == len(self.rest)] = 0
            good = self.keys[self.rest[at]] == keys[miss]
            out[miss[good]] = self.rest[at[good]]
        return out

    def spelled(self, code: int) -> float:
        return self.BYTE * len(chr(code).encode("utf-8", "surrogatepass"))

    def arcs(self, codes: np.ndarray):
        """(i, length, rows, piece numbers, log weights) of all arcs of words with equally many codes; piece -1 is spelled in bytes."""
        n, length = codes.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * BASE + codes[:, i] + np.uint64(1)
        out = []
        for i in range(length):
            most = min(self.longest, length - i)
            keys = prefix[i + 1 : i + 1 + most] - prefix[i] * self.powers[1 : most + 1, None]
            for size, found in enumerate(self.find(keys.ravel()).reshape(most, n), 1):
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    out.append((i, size, rows, found[rows], self.logp[found[rows]]))
                if size == 1 and i and len(rows) < n:
                    rows = np.flatnonzero(found < 0)
                    out.append((i, 1, rows, None, np.array([self.spelled(c) for c in codes[rows, i].tolist()])))
        return out

    @staticmethod
    def sums(arcs, n: int, length: int) -> np.ndarray:
        alpha = np.full((length + 1, n), NEVER)
        alpha[0] = 0
        for i, size, rows, _, weight in arcs:  # by ascending i, so alpha[i] is complete
            alpha[i + size, rows] = np.logaddexp(alpha[i + size, rows], alpha[i, rows] + weight)
        return alpha

    def steps(self, codes: tuple, i: int):
        """(length, piece number, log weight) of the arcs from ``i`` on; the number is None for what is spelled in bytes."""
        for size in range(1, min(self.longest, len(codes) - i) + 1):
            piece = self.table.get(codes[i : i + size])
            if piece is not None:
                yield size, piece, self.logp[piece]
            elif size == 1 and i:
                yield size, None, self.spelled(codes[i])

    def forward(self, codes: tuple) -> array:
        alpha = array("d", [NEVER]) * (len(codes) + 1)
        alpha[0] = 0.0
        for i in range(len(codes)):
            for size, _, weight in self.steps(codes, i):
                alpha[i + size] = log_add(alpha[i + size], alpha[i] + weight)
        return alpha

    def one(self, word: str) -> float:
        """The same sum for a single, long word."""
        return self.forward((START, *map(ord, word)))[-1] + self.end

    def add_uses(self, word: str, total: np.ndarray) -> None:
        """Adds a single, long word's expected uses of each piece to ``total``."""
        codes = (START, *map(ord, word))
        alpha = self.forward(codes)
        beta = array("d", [NEVER]) * (len(codes) + 1)
        beta[-1] = 0.0
        for i in reversed(range(len(codes))):
            for size, piece, weight in self.steps(codes, i):
                beta[i] = log_add(beta[i], weight + beta[i + size])
                if piece is not None:
                    total[piece] += math.exp(alpha[i] + weight + beta[i + size] - alpha[-1])

    def by_length(self, words: list[str], most: int = 48):
        """Index arrays of words of equal length up to ``most``, with their codes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        start = np.cumsum(lengths) - lengths
        for length in np.unique(lengths):
            if length <= most:
                at = np.flatnonzero(lengths == length)
                body = flat[start[at][:, None] + np.arange(length)]
                yield at, np.concatenate([np.full((len(at), 1), START, np.uint64), body], axis=1, dtype=np.uint64)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's sum over all segmentations."""
        out = np.full(len(words), np.nan)
        for at, codes in self.by_length(words):
            out[at] = self.sums(self.arcs(codes), *codes.shape)[-1] + self.end
        for i in np.flatnonzero(np.isnan(out)):
            out[i] = self.one(words[i])
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """Expected uses of each piece over the words' segmentations."""
        total, long = np.zeros(len(self.pieces)), np.ones(len(words), bool)
        for at, codes in self.by_length(words):
            long[at] = False
            n, length = codes.shape
            arcs = self.arcs(codes)
            alpha = self.sums(arcs, n, length)
            beta = np.full((length + 1, n), NEVER)
            beta[length] = 0
            for i, size, rows, _, weight in reversed(arcs):
                beta[i, rows] = np.logaddexp(beta[i, rows], beta[i + size, rows] + weight)
            for i, size, rows, piece, weight in arcs:
                if piece is not None:
                    total += np.bincount(piece, np.exp(alpha[i, rows] + weight + beta[i + size, rows] - alpha[length, rows]), len(total))
        for i in np.flatnonzero(long):
            self.add_uses(words[i], total)
        return total


def joint(lattices: list[Lattice], words: list[str]) -> np.ndarray:
    """``log_probabilities`` of each word in a row by each lattice in a column; the lattices differ in weights only, so they share the look-up of arcs."""
    first, logp, ends = lattices[0], np.stack([x.logp for x in lattices], 1), np.array([x.end for x in lattices])
    out = np.full((len(words), len(lattices)), np.nan)
    for at, codes in first.by_length(words):
        n, length = codes.shape
        alpha = np.full((length + 1, n, len(lattices)), NEVER)
        alpha[0] = 0
        for i, size, rows, piece, weight in first.arcs(codes):
            alpha[i + size, rows] = np.logaddexp(alpha[i + size, rows], alpha[i, rows] + (weight[:, None] if piece is None else logp[piece]))
        out[at] = alpha[length] + ends
    for i in np.flatnonzero(np.isnan(out[:, 0])):
        out[i] = [x.one(words[i]) for x in lattices]
    return out


def gathered(batches, most: int = 50_000):
    """Record batches put together to about ``most`` rows, for the sake of long arrays."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, held_out_fold: int, classes: list) -> DataFrame:
    """(word, c, n, c0, c1, ...): how often training documents, all documents, and the training documents of each class have each word.

    ``docs`` is (doc_id, text, class).
    """
    number = {value: k for k, value in enumerate(classes)}

    def run(batches):
        seen: dict[int | None, Counter] = {}
        for batch in batches:
            ids, groups = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, texts in common.slices(batch.column(1), 512):
                for i, group, text in zip(ids[at:], groups[at:], texts):
                    kind = None if common.fold(i) == held_out_fold else number.get(group, -1)
                    seen.setdefault(kind, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > 300_000:
                yield from emit(seen)
                seen.clear()
        yield from emit(seen)

    def emit(seen):
        for kind, counter in seen.items():
            items = list(counter.items())
            for at in range(0, len(items), 50_000):
                words, n = zip(*items[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([kind] * len(n), pa.int32()), pa.array(n, pa.int64())], ["word", "kind", "n"])

    counted = docs.mapInArrow(run, "word string, kind int, n long").groupBy("word")
    of = lambda test: F.coalesce(F.sum(F.expr(f"case when {test} then n end")), F.lit(0))
    return counted.agg(of("kind is not null").alias("c"), F.sum("n").alias("n"), *(of(f"kind = {k}").alias(f"c{k}") for k in range(len(classes))))


class Model:
    """The constants of all classes, the last being for documents of any class: tokens, distinct tokens, documents, prior, weights of the pieces and of the word's end."""

    def __init__(self, path: str, discount: float, classes: list[tuple]):
        self.path, self.discount, self.classes = path, discount, classes
        self.total, self.distinct, self.documents = classes[-1][:3]

    def lattices(self) -> list[Lattice]:
        first = Lattice(self.path)
        return [first.reweighed(share, end) for *_, share, end in self.classes]

    def base(self, c):
        """log10 of the additive estimate."""
        return np.log10((np.asarray(c) + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def log10(self, k: int, own, c, lattice):
        """log10 P_k of tokens seen ``own`` times in class ``k`` and ``c`` times in all, whose lattice sums to exp(``lattice``)."""
        own, c, lattice = (np.asarray(x, dtype=float) for x in (own, c, lattice))
        tokens, distinct = self.classes[k][:2]
        if not tokens:
            return lattice / math.log(10) + math.log10(0.5)
        log = lambda x: np.log(np.maximum(x, 1e-300))
        kept = np.where(own > self.discount, log((own - self.discount) / tokens), NEVER)
        if k < len(self.classes) - 1:
            known = np.where(c > self.discount, log((c - self.discount) / (self.total - self.discount * self.distinct)), NEVER)
            lattice = np.logaddexp(lattice + math.log(0.9), known + math.log(0.1))
        return np.logaddexp(kept, lattice + math.log(self.discount * distinct / tokens)) / math.log(10)

    def sums(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """For words in rows, seen ``counts`` times in each class and in all, with a column of ``lattice`` each: whether a word is known, its base, and log10 P_k of all classes."""
        c = counts[:, -1]
        return np.column_stack([(c > 0).astype(float), self.base(c), *(self.log10(k, counts[:, k], c, lattice[:, k]) for k in range(len(self.classes)))])

    def closing(self) -> np.ndarray:
        """Of the end of a document: whether it is known, base, and for each class log10 of prior and probability; the lattice has no end."""
        own = [math.log10(prior) + (float(self.log10(k, n, self.documents, NEVER)) if self.total else math.log10(0.5)) for k, (_, _, n, prior, *_) in enumerate(self.classes)]
        return np.array([float(self.documents > 0), float(self.base(self.documents)), *own])


def learn(counts: DataFrame, documents: int, in_classes: list[int], path: str, rounds: int = 2, prior: float = 0.001) -> Model:
    """The model of the word table ``counts`` and of so many training documents, in all and in each class."""
    k_all = len(in_classes)
    names = [*(f"c{k}" for k in range(k_all)), "c"]
    counts = counts.withColumn("rest", F.expr(" - ".join(["c", *names[:-1]])))  # uses in documents of no class
    sums = [x for k, name in enumerate(names) for x in (F.coalesce(F.sum(name), F.lit(0)).alias(f"n{k}"), F.count_if(F.col(name) > 0).alias(f"v{k}"))]
    said = counts.agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"), F.count_if(F.col("rest") > 0).alias("v_rest"), *sums).first()
    discount = min(0.95, max(0.1, said.once / (said.once + 2 * said.twice))) if said.once else 0.5
    pieces, begins, first = vocabulary(path)
    shares, ends = [first] * (k_all + 1), [0.1] * (k_all + 1)
    for _ in range(rounds if said[f"v{k_all}"] else 0):

        def run(batches, shares=shares, ends=ends):
            lattice, total = Lattice(path), np.zeros((k_all + 1, len(pieces)))
            for table in gathered(batches):
                words = np.array(table.column("word").to_pylist(), dtype=object)
                for k, name in enumerate([*names[:-1], "rest"]):
                    own = words[table.column(name).to_numpy() > 0]
                    if len(own):
                        total[k] += lattice.reweighed(shares[k], ends[k]).expected(own.tolist())
            kinds, places = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(places, pa.int32()), pa.array(total[kinds, places])], ["kind", "piece", "uses"])

        uses = np.zeros((k_all + 1, len(pieces)))
        for r in counts.where("c > 0").mapInArrow(run, "kind int, piece int, uses double").groupBy("kind", "piece").agg(F.sum("uses").alias("uses")).collect():  # a row for each piece and class at most
            uses[r.kind, r.piece] = r.uses
        uses[k_all] = uses.sum(axis=0)  # those of the classes and of the rest
        shares, ends = [], []
        for k in range(k_all + 1):
            words = said["v_rest"] + sum(said[f"v{i}"] for i in range(k_all)) if k == k_all else said[f"v{k}"]
            end = 0.95 * max(1, words) / max(2, words + uses[k][~begins].sum())
            share = np.empty(len(pieces))
            for mine, mass in ((begins, 1.0), (~begins, 0.95 - end)):
                new = uses[k][mine] + prior * max(1.0, uses[k][mine].sum()) * first[mine] / first[mine].sum()
                share[mine] = mass * new / new.sum()
            shares.append(share)
            ends.append(end)
    # a tenth of the prior is for documents of any class
    classes = [(said[f"n{k}"] + d, said[f"v{k}"] + 1, d, 0.9 * d / documents, shares[k], ends[k]) for k, d in enumerate(in_classes)]
    classes.append((said[f"n{k_all}"] + documents, said[f"v{k_all}"] + bool(documents), documents, 1 - sum(c[3] for c in classes), shares[k_all], ends[k_all]))
    return Model(path, discount, classes)


def rank_of(n: str):
    """Counts in steps of a sixteenth of a doubling: few values whatever the input."""
    return F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")


def threshold(counts: DataFrame, most: int) -> int:
    """The least ``rank_of`` n from which on the table has ``most`` words at most."""
    least, room = 1 << 30, most
    for r in sorted(counts.groupBy(rank_of("n").alias("rank")).count().collect(), key=lambda r: -r["rank"]):  # a row a step
        room -= r["count"]
        if room < 0:
            break
        least = r["rank"]
    return least


def score(docs: DataFrame, *, vocab_path: str | None = None, held_out_fold: int = 1, most_frequent: int = 200_000, class_column: str | None = "lang", most_classes: int = 8) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs(doc_id, text)``; classes are learned if ``docs`` has ``class_column``."""
    common.visible(docs.sparkSession)
    path = vocab_path or default_path()
    group = F.col(class_column).cast("string") if class_column in docs.columns else F.lit(None).cast("string")
    docs = docs.select("doc_id", "text", group.alias("class"))
    training = docs.where(common.fold_column() != held_out_fold)
    top_classes = training.groupBy("class").agg(F.count("*").alias("n")).select("class", "n", F.sum("n").over(Window.partitionBy()).alias("documents")).orderBy(F.desc("n"), "class").limit(most_classes).collect()  # a row a class
    documents = top_classes[0].documents if top_classes else 0
    counts = common.stored(word_counts(docs, held_out_fold, [r["class"] for r in top_classes]))
    model = learn(counts, documents, [r.n for r in top_classes], path)
    sc = docs.sparkSession.sparkContext
    columns = [*(f"c{k}" for k in range(len(top_classes))), "c"]
    least = threshold(counts, most_frequent)
    top = counts.where(rank_of("n") >= least).drop("n").toArrow()
    words = top.column("word").to_pylist()
    table = model.sums(np.column_stack([top.column(x).to_numpy() for x in columns]), joint(model.lattices(), words))
    shared, ends = sc.broadcast(({w.encode("utf-8"): i for i, w in enumerate(words)}, table)), model.closing()
    names = ["known", "base", *(f"m{k}" for k in range(len(columns)))]

    def per_document(batches):
        (frequent, table), row = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in common.slices(batch.column(1), 256):
                docs_out, rest = [], []
                for i, text in zip(ids[at:], texts):
                    words = words_of(text)
                    places, times = [], []
                    for word, n in Counter(words).items():
                        place = frequent.get(word)
                        if place is None:
                            rest.append((row, word, n))
                        else:
                            places.append(place)
                            times.append(n)
                    sums = ends + np.array(times, dtype=float) @ table[places] if places else ends
                    docs_out.append((row, i, common.fold(i) == held_out_fold, len(words) + 1, *sums.tolist()))
                    row += 1
                yield rows(docs_out, rest)

    def rows(docs_out, rest):
        r, i, h, t, *sums = zip(*docs_out)
        rr, w, n = zip(*rest) if rest else ((), (), ())
        none = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(len(rr), kind)])
        some = lambda values, kind: pa.concat_arrays([pa.nulls(len(r), kind), values.cast(kind)])
        return pa.RecordBatch.from_arrays(
            [pa.array(r + rr, pa.int64()), none(i, pa.int64()), none(h, pa.bool_()), none(t, pa.int64()), some(pa.array(w, pa.binary()), pa.string()), some(pa.array(n, pa.int64()), pa.int64()), *(none(x, pa.float64()) for x in sums)],
            ["row", "doc_id", "held_out", "n_tokens", "word", "times", *names],
        )

    doubles = ", ".join(f"{x} double" for x in names)
    parts = common.stored(docs.select("doc_id", "text").mapInArrow(per_document, f"row long, doc_id long, held_out boolean, n_tokens long, word string, times long, {doubles}"))

    def weigh(batches):
        """Rare words where they stand: (row, word, times, counts), sorted by word, to sums for each row and batch."""
        lattices = model.lattices()
        for table in gathered(batches):
            word = table.column("word").combine_chunks().dictionary_encode()
            place, first = np.unique(word.indices.to_numpy(), return_index=True)[1], word.indices.to_numpy()
            own = np.column_stack([table.column(x).to_numpy()[place] for x in columns])
            sums = model.sums(own, joint(lattices, word.dictionary.to_pylist()))[first] * table.column("times").to_numpy()[:, None]
            rows, place = np.unique(table.column("row").to_numpy(), return_inverse=True)
            total = [np.bincount(place, x, len(rows)) for x in sums.T]
            yield from pa.table([pa.array(rows), *map(pa.array, total)], names=["row", *names]).to_batches(50_000)

    rare = counts.where(rank_of("n") < least).drop("n")
    met = parts.where("word is not null").select("row", "word", "times").join(rare, "word").select("row", "word", "times", *columns)
    sums = met.mapInArrow(weigh, f"row long, {doubles}").groupBy("row").agg(*(F.sum(x).alias(f"rare_{x}") for x in names))
    out = parts.where("word is null").join(sums, "row", "left")
    plus = lambda x: F.col(x) + F.coalesce(f"rare_{x}", F.lit(0.0))
    out = out.select("doc_id", "held_out", "n_tokens", *(plus(x).alias(x) for x in names))
    each = [F.col(x) for x in names[2:]]
    top = F.greatest(*each) if len(each) > 1 else each[0]
    marginal = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in each), F.lit(0.0)))
    return out.select("doc_id", "held_out", "n_tokens", F.round("known").cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), marginal.alias("score"))


def op9_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
