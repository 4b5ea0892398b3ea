import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaar.llm import langid, toxicity


def word(rng, parts):
    return "".join(rng.choices(parts, k=rng.randint(1, 4)))


def languages(seed, n=300):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "eng", "ung"], "cc": ["éa", "oux", "lo"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join(word(rng, parts[lang]) for _ in range(rng.randint(3, 30))).title(), lang))
    return rows


def test_languages(make):
    docs = make(languages(1))
    model = langid.fit(docs.filter(~langid.held_out()))
    got = langid.detect(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out()).collect()
    assert len(got) > 50 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_backoff_by_hand():
    """A known word scores its log; an unseen one the mean of its known longest n-grams; others nothing."""
    batch = langid.Batch(["ab"])
    known, tri = batch.words(), langid.Batch(["abx"]).grams(np.array([0]), 3)[1]
    empty = np.zeros(0, np.uint64), np.zeros((0, 2))
    levels = [(known, np.array([[-1.0, -2.0]])), empty, empty, (tri[:1], np.array([[-7.0, -3.0]])), empty, empty]
    model = langid.Model(["x", "y"], [k for k, _ in levels], [v for _, v in levels])
    s, n = langid.scores(model, model.indexes(), ["ab ab", "AB, abz", "zzz", "", None, "12"])
    assert n.tolist() == [2, 2, 1, 0, 0, 0]
    assert s.tolist() == [[-2, -4], [-8, -5], [0, 0], [0, 0], [0, 0], [0, 0]]


def test_languages_of_odd_rows(make, odd):
    model = langid.fit(make(languages(2)))
    got = langid.detect(odd, model).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 6)} == {"und"}
    assert "und" not in {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 9)}
    none = langid.fit(make([(1, "a", None), (2, None, "en")]))
    assert {r["lang_pred"] for r in langid.detect(odd, none).collect()} == {"und"}
    assert langid.detect(make([]), model).collect() == []


def toxic(seed, n=600):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        words = [word(rng, ["ba", "ke", "lu", "ri", "so"]) for _ in range(rng.randint(10, 60))]
        for _ in range(rng.randint(2, 5) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["vilest", "scornful", "cursed"])
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, make):
    rows, labels = toxic(1)
    docs, known = make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, known)).join(known, "doc_id").filter(langid.held_out()).collect()
    caught = [r["score"] >= toxicity.TOXIC for r in got if r["toxic"]]
    wrong = [r["score"] >= toxicity.TOXIC for r in got if not r["toxic"]]
    assert np.mean(caught) > 0.8 and np.mean(wrong) < 0.05
    again = toxicity.score(docs.repartition(5), toxicity.learn(docs.repartition(7), known)).collect()
    assert {r["doc_id"]: r["score"] for r in again}.items() >= {r["doc_id"]: r["score"] for r in got}.items()
    clean = toxicity.keep_clean(docs, toxicity.learn(docs, known), toxicity.TOXIC)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in again if r["score"] < toxicity.TOXIC}


def test_only_near_copies_are_folded():
    """As brute force on sets that share their common keys; what is under 0.8 to every text that stays, stays."""
    rng = np.random.default_rng(3)
    docs = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
    for _ in range(80):
        one = np.unique(np.concatenate([np.arange(40), rng.integers(100, 400, rng.integers(1, 60))])).astype(np.uint32)
        docs.append(one)
        for drop in rng.integers(0, len(one) // 3, 2):
            docs.append(np.sort(rng.permutation(one)[drop:]))
    docs.append(np.array([1, 2, 3, 4], np.uint32))
    docs.append(np.array([1, 2, 3, 4, 5], np.uint32))  # 0.8 exactly
    want = []
    for d in docs:
        sets = [(set(d.tolist()), set(w.tolist())) for w in want]
        if not any(not (a | b) or 5 * len(a & b) >= 4 * len(a | b) for a, b in sets):
            want.append(d)
    got = toxicity.one_of_copies(docs)
    assert [g.tolist() for g in got] == [w.tolist() for w in want] and 50 < len(got) < len(docs) - 20
    assert toxicity.one_of_copies([]) == []


def test_risk_gradient():
    """Where the estimate for clean text is positive a step lowers the risk."""
    rng = np.random.default_rng(1)
    p = [np.array([0, 1]) for _ in range(30)]
    u = [np.array([1]) if rng.random() > 0.2 else np.array([0, 1]) for _ in range(300)]
    w, b = toxicity.fit_one(p, u, np.ones(2), 0.2, rng)
    f = lambda x: 1 / (1 + np.exp(-(b + w[x].sum())))
    assert f(np.array([0, 1])) > 0.8 and f(np.array([1])) < 0.1


@pytest.mark.parametrize("logistic", [True, False])
@pytest.mark.parametrize("shift", [3.0, -3.0])
def test_slopes_are_those_of_the_risk(logistic, shift):
    """Finite differences of the risk as its formula stands in the paper, on either side of zero."""
    rng = np.random.default_rng(4)
    f_p, f_u, prior = rng.normal(size=7) + 3, rng.normal(size=11) + shift, 0.3
    loss = (lambda z: np.log1p(np.exp(-z))) if logistic else (lambda z: 1 / (1 + np.exp(z)))
    clean = lambda p, u: loss(-u).mean() - prior * loss(-p).mean()
    whole = lambda p, u: prior * loss(p).mean() + clean(p, u)
    goal = whole if clean(f_p, f_u) >= 0 else lambda p, u: -clean(p, u)
    got, d_p, d_u = toxicity.risk(f_p, f_u, prior, logistic)
    assert got == pytest.approx(clean(f_p, f_u))
    for d, f, change in ((d_p, f_p, lambda g: (g, f_u)), (d_u, f_u, lambda g: (f_p, g))):
        for i in range(len(f)):
            step = np.zeros(len(f))
            step[i] = 1e-5
            assert d[i] == pytest.approx((goal(*change(f + step)) - goal(*change(f - step))) / 2e-5, abs=1e-7)


def test_query_scores_as_brute_force(spark, toxic_score):
    """op9's rows from its model, text by text."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.op9_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(toxic_score(model, r["text"]), abs=1e-6) and g["predicted"] == int(g["score"] >= 0.3)
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_rare_features_count_little_but_count():
    v = toxicity.values(np.array([1, 3, 10, 0]), np.array([0, 0, 0, 500]), 40, 700)
    assert 0 < v[3] < v[0] < 0.01 < v[1] < 0.5 < 0.99 < v[2] < 1


def test_toxicity_of_odd_rows(spark, make, odd):
    rows, labels = toxic(2, 200)
    model = toxicity.learn(make(rows), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int"))
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(make([]), model).collect() == [] and toxicity.keep_clean(odd, model, 2.0).count() == odd.count()
    none = toxicity.learn(make(rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(odd, none).agg(F.max("score")).first()[0] < 0.01


@pytest.mark.parametrize("rows", [0, 3])
def test_learning_without_examples(spark, make, rows):
    docs = make([(i, "some text") for i in range(rows)])
    model = toxicity.learn(docs, spark.createDataFrame([(0, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == rows
