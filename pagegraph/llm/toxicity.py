"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Learning takes a bounded sample of labelled training rows.  A term enters the lexicon if
toxic rows use it in many different contexts and clean rows hardly ever; where a whole
family of words shares a beginning, the beginning itself enters as a stem.  Counting
contexts rather than rows keeps out words of toxic texts that were merely copied.

The lexicon is a trie.  Its product with the Levenshtein automaton of one edit is made
deterministic as words are read: a state is the set of trie nodes reachable with no or
one edit spent.  Most words leave it after a few letters, and distinct words are looked
up once in a worker's bounded cache.

Each hit is weighed by its context window: more beside a form of address or another hit.
It counts as quotation if quotation marks enclose it, or a word of reporting stands
directly before it in its clause, unless the clause addresses somebody: reporting outside
the clause excuses nothing.  A logistic model of the summed weights gives the score; the
weight of quotation is fitted as a departure from half of that of plain speech, so what
the sample never shows in quotation counts half, not nothing.

Edge cases: null and empty texts have no hits; labels that are null, or null doc_ids,
teach nothing; several labels of one document count as toxic if one is; without toxic
rows to learn from every score is the constant of the model; repeated rows give repeated
results; rows that tie in the sample's order go by doc_id; texts of any length are scored
whole; other columns, names like ``score`` included, pass through ``drop_toxic``; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MISSPELLED = 0.8  # of the weight of a term as spelled
WORD = re.compile(r"[^\W_]+")
QUOTED = 0.5  # of the weight of plain speech, before the sample says otherwise
STEM_MOST = 10  # longer stems are found by their first letters
# Context cues in English, French, German and Spanish.
REPORTING = frozenset("said says saying wrote writes quoted quote quoting called reported dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your youre yourself u ur tu toi ton vous votre du dich dir dein deine euch ti tus usted ustedes".split())
QUOTES = "\"“”«»„"
CLAUSE_ENDS = ".!?;"


class Lexicon:
    """Terms and stems as a trie, read through a lazily determinised one-edit Levenshtein automaton."""

    def __init__(self, terms: dict[str, tuple[bool, bool]]):
        """``terms``: term -> (is it a stem, may it be misspelled by one edit)."""
        self.children: list[dict[str, int]] = [{}]
        self.kind: list[tuple[bool, bool, str] | None] = [None]
        for term, (stem, edit) in terms.items():
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.kind.append(None)
                node = self.children[node][c]
            self.kind[node] = (stem, edit, term)
        self.moves: list[dict[str, int]] = []
        self.value: list[tuple[float, float]] = []  # (as a stem from here on, at the word's end)
        self.known: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.start = self.state({(0, 0)})

    def state(self, nodes: set[tuple[int, int]]) -> int:
        """The number of a set of (trie node, edits spent), closed under letters left out."""
        closed = set(nodes)
        for node, spent in nodes:
            if not spent:
                closed |= {(child, 1) for child in self.children[node].values()}
        key = frozenset(closed)
        if key not in self.known:
            self.known[key] = len(self.moves)
            self.sets.append(key)
            ends = [(self.kind[n], spent) for n, spent in key if self.kind[n]]
            good = [(stem, MISSPELLED if spent else 1.0) for (stem, edit, _), spent in ends if edit or not spent]
            self.moves.append({})
            self.value.append((max((v for stem, v in good if stem), default=0.0), max((v for _, v in good), default=0.0)))
        return self.known[key]

    def step(self, state: int, c: str) -> int:
        """-1: no term is left."""
        after = set()
        for node, spent in self.sets[state]:
            if c in self.children[node]:
                after.add((self.children[node][c], spent))
            if not spent:
                after.add((node, 1))  # a letter too many
                after |= {(child, 1) for child in self.children[node].values()}  # another letter
        to = self.moves[state][c] = self.state(after) if after else -1
        return to

    def near(self, word: str) -> set[str]:
        """The terms that are one edit from ``word`` or equal it, and the stems of which that holds for a beginning of it."""
        state, found = self.start, set()
        for c in word:
            to = self.moves[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                return found
            found |= {self.kind[n][2] for n, _ in self.sets[state] if self.kind[n] and self.kind[n][0]}
        return found | {self.kind[n][2] for n, _ in self.sets[state] if self.kind[n]}

    def match(self, word: str) -> float:
        """1 for a term or a word that begins with a stem, less with one edit in the term or stem, else 0."""
        state, found = self.start, 0.0
        for c in word:
            to = self.moves[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                return found
            found = max(found, self.value[state][0])
        return max(found, self.value[state][1])


class Hits(dict):
    """Blank-separated lower-case word -> match of its best part; a cache of a stated size."""

    def __init__(self, lexicon: Lexicon, most: int = 400_000):
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> float:
        value = max(map(self.lexicon.match, WORD.findall(word)), default=0.0) if len(word) <= 200 else max(map(self.lexicon.match, (m[0] for m in WORD.finditer(word))), default=0.0)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def opens(word: str) -> bool:
    return word.lstrip("([{-")[:1] in QUOTES and bool(word)


def closes(word: str) -> bool:
    bare = word.rstrip(".,;:!?)]}")
    return bare[-1:] in QUOTES and bool(bare)


def in_quotation(words: list[str], i: int, longest: int = 40, before: int = 3) -> bool:
    """Do quotation marks at most ``longest`` words away on either side enclose word ``i``, or does a word of reporting stand in its clause among the ``before`` words ahead of it?"""
    for a in range(i, max(-1, i - longest), -1):
        if a < i and closes(words[a]):
            break
        if opens(words[a]):
            for b in range(i, min(len(words), i + longest)):
                if b > max(a, i) and opens(words[b]):
                    break
                if closes(words[b]):
                    return True
            break
    for a in range(i - 1, max(-1, i - 1 - before), -1):
        if words[a][-1] in CLAUSE_ENDS:
            return False
        if not REPORTING.isdisjoint(WORD.findall(words[a])):
            return True
    return False


def clause(words: list[str], i: int, window: int) -> set[str]:
    """The bare words of the clause around word ``i``, ``window`` words on either side at most."""
    a = i
    while a > max(0, i - window) and words[a - 1][-1] not in CLAUSE_ENDS:
        a -= 1
    b = i
    while b < min(len(words) - 1, i + window) and words[b][-1] not in CLAUSE_ENDS:
        b += 1
    return {m for w in words[a : b + 1] for m in WORD.findall(w)}


def evidence(text: str | None, hits: Hits, window: int = 6) -> tuple[float, float]:
    """Weights of the terms in plain speech, a misspelled one less, and of terms in quotation."""
    words = (text or "").lower().split()
    values = [*map(hits.__getitem__, words)]
    if not any(values):
        return 0.0, 0.0
    plain = quoted = 0.0
    for i, v in enumerate(values):
        if not v:
            continue
        addressed = not ADDRESS.isdisjoint(clause(words, i, window))
        weight = v * (1.0 + 0.5 * addressed + 0.25 * min(4, sum(1 for x in values[max(0, i - window) : i + 1 + window] if x) - 1))
        if not addressed and in_quotation(words, i):
            quoted += weight
        else:
            plain += weight
    return plain, quoted


def features(weights: tuple[float, float]) -> list[float]:
    plain, quoted = map(math.log1p, weights)
    return [1.0, plain + QUOTED * quoted, quoted]


def learn_terms(rows: list[tuple[str, int]], *, chance: float = 1.0, most_clean: float = 0.02, stem_from: int = 4, family: int = 4) -> dict[str, tuple[bool, bool]]:
    """Lexicon terms (term -> (is it a stem, may it be misspelled)) from (text, toxic) rows.

    A term needs so many toxic rows and contexts that fewer than ``chance`` words of the
    vocabulary would reach them if words fell on rows by accident.  It may be misspelled
    if hardly any word of clean rows is one edit away, a stem if hardly any begins so.
    """
    contexts: dict[str, set] = defaultdict(set)
    toxic_rows: Counter = Counter()
    clean: Counter = Counter()
    toxic_words, n = [], [0, 0]
    for text, toxic in rows:
        n[bool(toxic)] += 1
        words = [" ".join(WORD.findall(w)) for w in text.lower().split()]
        if toxic:
            for before, word in zip(["", *words], words):
                contexts[word].add(before)
            toxic_words.append(set(words))
            toxic_rows.update(toxic_words[-1])
        else:
            clean.update(set(words))
    if not all(n):
        return {}
    share = n[1] / sum(n)
    least = max(4, math.ceil(math.log(max(2, len(contexts)) / chance) / -math.log(share)))
    pure = lambda toxic_n, clean_n: clean_n * n[1] <= most_clean * toxic_n * n[0]
    clean_heads: Counter = Counter()
    for word, k in clean.items():
        for m in range(stem_from, min(len(word), STEM_MOST) + 1):
            clean_heads[word[:m]] += k
    forms: dict[str, set] = defaultdict(set)
    for word in contexts:
        for m in range(stem_from, min(len(word), STEM_MOST) + 1):
            if pure(n[1], clean_heads[word[:m]]):
                forms[word[:m]].add(word)
    forms = {h: own for h, own in forms.items() if len(own) >= family and sum(toxic_rows[w] for w in own) >= least}
    with_head: Counter = Counter()
    for words in toxic_words:
        with_head.update({w[:m] for w in words for m in range(stem_from, min(len(w), STEM_MOST) + 1) if w[:m] in forms})
    seen = {h: len(set().union(*(contexts[w] for w in own))) for h, own in forms.items()}
    good = {h for h in forms if with_head[h] >= least and seen[h] >= max(least, 0.6 * with_head[h]) and pure(with_head[h], clean_heads[h])}
    good = {h for h in good if not any(o != h and o.startswith(h) and with_head[o] >= 0.9 * with_head[h] for o in good)}
    stems = {h for h in good if not any(o != h and h.startswith(o) for o in good)}
    words = [(-len(c), w) for w, c in contexts.items() if len(w) >= 3 and toxic_rows[w] >= least and len(c) >= max(least, 0.6 * toxic_rows[w]) and pure(toxic_rows[w], clean[w]) and not any(w.startswith(h) for h in stems)]
    terms = {h: True for h in sorted(stems)} | {w: False for _, w in sorted(words)}
    beside: Counter = Counter()
    lexicon = Lexicon({t: (stem, True) for t, stem in terms.items()})
    for word, k in clean.items():
        for term in lexicon.near(word):
            beside[term] += k
    return {t: (stem, pure(with_head[t] if stem else toxic_rows[t], beside[t])) for t, stem in terms.items()}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.002, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps, the constant unpenalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Terms and weights: all that a worker needs, a few hundred kilobytes at most."""

    def __init__(self, terms: dict[str, tuple[bool, bool]], weights: list[float]):
        self.terms, self.weights = terms, weights

    def scorer(self):
        hits = Hits(Lexicon(self.terms))

        def score(text: str | None) -> float:
            z = sum(a * b for a, b in zip(self.weights, features(evidence(text, hits))))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def train(docs: DataFrame, labels: DataFrame, *, most_toxic: int = 1_000, most_clean: int = 3_000, most_bytes: int = 64 << 20) -> Model:
    """Learns from at most ``most_toxic`` and ``most_clean`` labelled rows of the training folds, taken in the order of a hash of doc_id while their texts together keep to ``most_bytes``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (common.fold_column() != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).select("doc_id", "_toxic", F.xxhash64("doc_id").alias("_order"))
    sample = None
    for label, most in ((1, most_toxic), (0, most_clean)):
        part = known.where(F.col("_toxic") == label).orderBy("_order", "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    chosen = {r.doc_id: (r._order, r._toxic) for r in sample.collect()}  # at most most_toxic + most_clean rows
    fetch = lambda ids: docs.select("doc_id", "text").join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id")
    sizes = {r.doc_id: r.n for r in fetch(chosen).groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    room, taken = most_bytes, []
    for i in sorted(sizes, key=lambda i: (chosen[i][0], i)):
        if (sizes[i] or 0) <= room:
            room -= sizes[i] or 0
            taken.append(i)
    if not taken:
        return Model({}, [-5.0, 0.0, 0.0])
    rows = sorted((r.doc_id, r.text or "", chosen[r.doc_id][1]) for r in fetch(taken).collect())
    rows = [(t, y) for _, t, y in rows]
    terms = learn_terms(rows)
    hits = Hits(Lexicon(terms))
    x = np.array([features(evidence(t, hits)) for t, _ in rows])
    return Model(terms, fit(x, np.array([y for _, y in rows], dtype=float)).tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs(doc_id, text)``."""
    common.visible(docs.sparkSession)

    def run(batches):
        one = model.scorer()
        for batch in batches:
            scores = [one(t) for _, some in common.slices(batch.column(1), 512) for t in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    common.visible(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        one = model.scorer()
        for batch in batches:
            keep = [one(t) < threshold for _, some in common.slices(batch.column(at), 512) for t in some]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.fold_column() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
