import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bazaar.llm import substrings as m


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(8, 40))) for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            words = p.split()
            lo = rng.randrange(len(words))
            parts.append(" ".join(rng.choices(vocab, k=rng.randint(0, 20))))
            parts.append(" ".join(words[lo:]) if rng.random() < 0.5 else p)
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    texts += texts[:10]
    rng.shuffle(texts)
    return list(enumerate(texts))


def check(make, rows):
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256((r["kept"] or "").encode()).hexdigest()) for r in m.remove(make(rows)).collect())
    want = sorted((d is None, d, *x) for (d, _), x in zip(rows, m.brute_force(rows), strict=True))
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(make, seed):
    check(make, corpus(seed))


def test_heavy_keys_and_small_shards(make, monkeypatch):
    monkeypatch.setattr(m, "HEAVY_KEY", 5)
    monkeypatch.setattr(m, "SHARD", 7)
    check(make, corpus(3))


def test_odd_rows(make, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in m.remove(odd).collect()}
    want = {(d, *x[:2]) for (d, _), x in zip(rows, m.brute_force(rows), strict=True)}
    assert got == want
    assert {r["kept"] for r in m.remove(odd).collect() if r["doc_id"] == 1} == {None}


def test_one_id_two_texts(make):
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    check(make, [(1, a), (3, "x " + a), (3, b + " y"), (2, b), (3, "x " + a)])


@pytest.mark.parametrize("name", ["'d' || lpad(doc_id, 3, '0')", "doc_id + 0.25", "doc_id / 7D"])
def test_ids_of_other_types(make, name):
    """Texts, decimals and doubles in the same order give the same rows; none are cast or merged."""
    rows = corpus(4)
    got = m.remove(make(rows).withColumn("doc_id", F.expr(name))).select("doc_id", "n_words", "n_removed", "kept").orderBy("doc_id").collect()
    want = m.brute_force(rows)
    assert [(r["n_words"], r["n_removed"], hashlib.sha256((r["kept"] or "").encode()).hexdigest()) for r in got] == want


def test_empty(make):
    assert m.remove(make([])).collect() == []


def test_automaton():
    rng = random.Random(5)
    docs = [tuple(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(40)]
    for n in (2, 4):
        found = m.first_documents(docs, list(range(len(docs))), n)
        for d, row in zip(docs, found, strict=True):
            for i, first in enumerate(row):
                assert first == next(k for k, e in enumerate(docs) if any(e[j : j + n] == d[i : i + n] for j in range(len(e) - n + 1)))
