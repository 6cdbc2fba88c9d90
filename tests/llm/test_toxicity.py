"""op5: automata against edit distances, and held-out accuracy."""

import random

import numpy as np

from pagegraph.llm import common, toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = {"idiot": (False, True), "scum": (False, False), "lowei": (True, False), "moron": (False, True)}
    lexicon, rng = toxicity.Lexicon(terms), random.Random(4)
    words = ["", "idiot", "idot", "idioot", "1diot", "scum", "scam", "loweix", "lowe", "morons", "mron"]
    words += ["".join(rng.choice("idotmrnscu") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    for w in words:
        exact = w in ("idiot", "scum", "moron") or w.startswith("lowei")
        near = any(edits(w, t) <= 1 for t in ("idiot", "moron"))
        assert lexicon.match(w) == (1.0 if exact else toxicity.MISSPELLED if near else 0.0), w


def test_quotation_weighs_less_than_abuse():
    hits = toxicity.Hits(toxicity.Lexicon({"idiot": (False, True)}))
    assert toxicity.evidence("you idiot you", hits)[0] > toxicity.evidence("what an idiot", hits)[0] > 0
    assert toxicity.evidence('then he "idiot" and left', hits)[0] == 0 < toxicity.evidence('then he "idiot" and left', hits)[1]
    assert toxicity.evidence("she said idiot", hits)[1] > 0
    assert 0 < toxicity.evidence("such an idi0t", hits)[0] < 1
    assert toxicity.evidence(None, hits) == (0, 0)


def test_reporting_outside_the_clause_excuses_nothing():
    hits = toxicity.Hits(toxicity.Lexicon({t: (False, True) for t in ("stupid", "idiot", "moron")}))
    plain = lambda text: toxicity.evidence(text, hits)[1] == 0 < toxicity.evidence(text, hits)[0]
    quoted = lambda text: toxicity.evidence(text, hits)[0] == 0 < toxicity.evidence(text, hits)[1]
    assert plain("you are a stupid idiot and a moron he said") and plain("he said you are an idiot")
    assert plain("so called stupid idiot moron you are") and plain("he said so. idiot!") and plain('what "fun" this idiot has "had"')
    assert plain("il a dit tu idiot") and plain('an "idiot without a closing mark')
    assert quoted('he wrote: "stupid idiot moron" and left') and quoted('the word “idiot” is old') and quoted("she said: moron")
    model = toxicity.Model({t: (False, True) for t in ("stupid", "idiot", "moron")}, toxicity.fit(np.array([[1.0, 0.0, 0.0]] * 50 + [[1.0, 2.0, 0.0]] * 50), np.array([0.0] * 50 + [1.0] * 50)).tolist())
    one = model.scorer()
    assert min(map(one, ("you are a stupid idiot and a moron he said", "so called stupid idiot moron you are"))) >= 0.5
    assert one("nothing here") < one('they wrote "idiot" once') < one("they are idiot once")


def test_a_stem_may_be_misspelled():
    lexicon, rng = toxicity.Lexicon({"lowei": (True, True)}), random.Random(1)
    for w in ["loweibung", "lowibung", "1oweibung", "loeweibung", "lower", "lo", *("".join(rng.choice("lowei") for _ in range(rng.randint(1, 8))) for _ in range(2000))]:
        near = any(edits(w[:k], "lowei") <= 1 for k in range(len(w) + 1))
        assert lexicon.match(w) == (1.0 if w.startswith("lowei") else toxicity.MISSPELLED if near else 0.0), w
        assert lexicon.near(w) == ({"lowei"} if near else set())


def test_the_sample_keeps_to_its_bounds(spark):
    docs, labels = corpus(spark, 120)
    assert toxicity.train(docs, labels, most_bytes=0).terms == {}
    few = toxicity.train(docs, labels, most_toxic=3, most_clean=5)
    assert few.weights != toxicity.train(docs, labels).weights


def corpus(spark, n=600):
    rng = random.Random(9)
    plain = ["".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    bad = ["glorbnak", "vextram", "quixlop"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(80)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(9001, " ".join(plain[:40]) + " glorbnakk vextraam"), (9002, None), (9003, ""), (None, "glorbnak vextram glorbnak")]
    labels += [(9001, None), (None, 1), (6, 1), (6, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    assert {"glorbnak", "vextram", "quixlop"} <= set(model.terms)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null and doc_id < 9000").collect()}
    held = [i for i in truth if common.fold(i) == 0]
    assert len(held) > 80
    assert all((got[i] >= 0.5) == (i % 6 == 0) for i in held)
    assert got[9001] >= 0.5 and got[9002] == got[9003] < 0.5
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}


def test_edge_cases(spark, sf_dir, nasty, nothing):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(nothing, labels)
    assert toxicity.score(nothing, model).count() == 0
    model = toxicity.train(nasty, labels.limit(0))
    rows = toxicity.score(nasty, model).collect()
    assert len(rows) == nasty.count() and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.drop_toxic(nasty, model).exceptAll(nasty).isEmpty()


def test_query(spark, sf_dir):
    rows = toxicity.op5_lexicon_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (common.fold(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in toxicity.op5_lexicon_toxicity(spark, folder).where("held_out").collect() if r.doc_id in truth]
    caught = sum(p and t for p, t in held)
    assert caught >= 0.9 * sum(t for _, t in held) and caught >= 0.98 * sum(p for p, _ in held)
