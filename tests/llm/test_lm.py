"""op9: the lattice against enumeration, the base score against counting."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from pagegraph.llm import common, lm


@pytest.fixture(scope="module")
def lattice():
    return lm.Lattice(lm.default_path())


def enumerate_sum(lattice, word):
    """Sum over all segmentations, one by one."""
    codes, total = (lm.START, *map(ord, word)), 0.0
    for cuts in itertools.product([False, True], repeat=len(codes) - 1):
        at = [0, *(i for i, c in enumerate(cuts, 1) if c), len(codes)]
        weight = 0.0
        for a, b in zip(at, at[1:]):
            piece = lattice.table.get(codes[a:b])
            if piece is not None:
                weight += lattice.logp[piece]
            elif b == a + 1 and a:
                weight += lattice.spelled(codes[a])
            else:
                weight = -math.inf
                break
        total += math.exp(weight)
    return math.log(total) + lattice.end


def test_forward_sum_is_the_sum_over_segmentations(lattice):
    words = ["the", "thlyou", "é", "", "straße", "梦想a", "\U0001f642x", "aaaaaaaa"]
    got = lattice.log_probabilities(words)
    for w, p in zip(words, got):
        assert p == pytest.approx(enumerate_sum(lattice, w), abs=1e-9)
        assert p == pytest.approx(lattice.one(w), abs=1e-9)
    assert np.isfinite(lattice.log_probabilities(["z" * 3000])).all()
    other = lattice.reweighed(np.exp(lattice.logp)[::-1], 0.2)
    both = lm.joint([lattice, other], [*words, "z" * 100])
    assert both[:-1, 0] == pytest.approx(got) and both[:, 1] == pytest.approx(other.log_probabilities([*words, "z" * 100]))


def test_expected_uses_add_up(lattice):
    for word in ("the", "thlyou"):
        uses = lattice.expected([word])
        lengths = np.array([len(p) for p in lattice.pieces])
        assert (uses * lengths).sum() == pytest.approx(len(word) + 1)  # every letter and the start belong to one piece


def test_long_words_teach_too(lattice):
    uses = lattice.expected(["thlyou" * 10, "the"]) - lattice.expected(["the"])
    assert (uses * np.array([len(p) for p in lattice.pieces])).sum() == pytest.approx(61)
    short = np.zeros(len(lattice.pieces))
    lattice.add_uses("thlyou", short)
    assert short == pytest.approx(lattice.expected(["thlyou"]))


def test_words_of_no_class_reach_the_weights(spark):
    rows = [("zebra", 3, 0), ("zebu", 1, 0), ("gazelle", 2, 0)]
    counts = spark.createDataFrame(rows, "word string, c long, c0 long")
    path = lm.default_path()
    with_class = lm.learn(counts, 4, [0], path).classes[-1]
    without = lm.learn(counts.drop("c0"), 4, [], path).classes[-1]
    assert with_class[-2] == pytest.approx(without[-2]) and with_class[-1] == pytest.approx(without[-1])


def check(rows, frame):
    docs = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    counts, n_docs = Counter(), 0
    for i, text in docs:
        if common.fold(i) != 1:
            counts.update(lm.words_of(text))
            n_docs += 1
    total, distinct = sum(counts.values()) + n_docs, len(counts) + bool(n_docs)
    base = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    want = []
    for i, text in docs:
        words = lm.words_of(text)
        want.append((i, common.fold(i) == 1, len(words) + 1, sum(counts[w] > 0 for w in words) + bool(n_docs), total, sum(base(counts[w]) for w in words) + base(n_docs)))
    got = sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), r[2]))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=lambda r: (str(r[0]), r[2]))]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in sorted(want, key=lambda r: (str(r[0]), r[2]))])
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)
    return got


def test_scores(spark, sf_dir, nasty, nothing, docs):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    few = check(lm.score(nasty, most_frequent=3).select(*columns).collect(), nasty)
    many = check(lm.score(nasty, most_frequent=1000).select(*columns).collect(), nasty)
    assert [g[6] for g in few] == pytest.approx([g[6] for g in many])  # where a word is scored doesn't matter
    assert lm.score(nothing).count() == 0
    check(lm.op9_subword_lattice(spark, sf_dir).select(*columns).collect(), docs)


def test_no_training_documents(spark):
    ids = [i for i in range(60) if common.fold(i) == 1][:3]
    frame = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")
    rows = lm.score(frame).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


def test_the_marginal_against_its_definition(spark, lattice):
    rng = np.random.default_rng(3)
    vocabulary = ["the", "thlyou", "a", "é", "ouwhea", "zz"]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 3 :], 12)), ["en", "fr", None][i % 3]) for i in range(40)] + [(40, "neverseen the", "en"), (41, "", "xx")]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_frequent=2, most_classes=3).collect()}
    training = [(t.split(), c) for i, t, c in rows if common.fold(i) != 1]
    classes = sorted({c for _, c in training}, key=lambda c: (-sum(x == c for _, x in training), c is not None, c or ""))[:3]
    groups = [*([w for w, x in training if x == c] for c in classes), [w for w, _ in training]]
    counts = [Counter(w for words in g for w in words) for g in groups]
    seen = spark.createDataFrame([(w, *(c[w] for c in counts)) for w in counts[-1]], "word string, c0 long, c1 long, c2 long, c long")
    model = lm.learn(seen, len(training), [len(g) for g in groups[:-1]], lm.default_path())
    weighed, d = model.lattices(), model.discount
    tokens, distinct = [sum(c.values()) + len(g) for c, g in zip(counts, groups)], [len(c) + 1 for c in counts]
    share = lambda n, k: max(n - d, 0) / tokens[k]
    spread = lambda n: max(n - d, 0) / (tokens[-1] - d * distinct[-1])
    last = len(groups) - 1

    def probability(k, own, c, subwords):
        free = subwords if k == last else 0.9 * subwords + 0.1 * spread(c)
        return share(own, k) + d * distinct[k] / tokens[k] * free

    for i, text, _ in rows:
        total = 0.0
        for k, g in enumerate(groups):
            p = 0.9 * len(g) / len(training) if k < last else 1 - 0.9 * sum(len(x) for x in groups[:-1]) / len(training)
            for w in text.split():
                p *= probability(k, counts[k][w], counts[-1][w], math.exp(enumerate_sum(weighed[k], w)))
            total += p * probability(k, len(g), len(training), 0.0)
        assert got[i] == pytest.approx(math.log10(total), rel=1e-6), i


def test_threshold(spark):
    counts = spark.createDataFrame([(w,) for w in (1, 1, 1, 2, 2, 3, 900, 1000, 5000)], "n long")
    for most, want in ((0, 0), (1, 1), (2, 2), (4, 4), (5, 4), (6, 6), (9, 9), (100, 9)):
        assert counts.where(lm.rank_of("n") >= lm.threshold(counts, most)).count() == want


def test_the_model_is_a_distribution():
    # five words, one of them in class 0 only, and documents' ends; what the discount frees is the lattice's share
    tokens, seen, in_class = 1000, np.array([400, 300, 150, 90, 10]), np.array([0, 280, 0, 0, 10])
    model = lm.Model("", 0.6, [(300, 3, 10, 0.5, None, 0.1), (tokens, 6, 50, 0.5, None, 0.1)])
    for k, own, freed in ((0, in_class, 0.9 * 0.6 * 3 / 300), (1, seen, 0.6 * 6 / tokens)):
        words = 10 ** model.log10(k, own, seen, np.full(5, -np.inf))
        end = 10 ** (model.closing()[2 + k] - math.log10(0.5))
        assert words.sum() + end + freed == pytest.approx(1)
