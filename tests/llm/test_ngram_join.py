import random

import numpy as np
import pytest

from bazaar.llm import ngram_join as m


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 80))) for _ in range(60)]
    for _ in range(6):
        texts += near_copies(rng, rng.choices(vocab, k=rng.randint(30, 120)), 15, 6)
    texts += texts[:5] + ["", None, "one two", "one two", "ONE, two!"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "sets"), [(1, 4096), (2, 8)])
def test_as_brute_force(spark, make, monkeypatch, seed, sets):
    monkeypatch.setattr(m, "BLOCK_SETS", sets)
    rows = corpus(seed)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in m.links(make(rows)).collect()}
    want = m.brute_force(rows)
    assert len(got) == len(rows)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


@pytest.mark.parametrize("sets", [512, 6])
def test_buckets_of_strays(make, monkeypatch, sets):
    """Texts that share a passage agree in a band here and there: large buckets of sets of many clusters."""
    monkeypatch.setattr(m, "BLOCK_SETS", sets)
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(2000)]
    shared = rng.choices(vocab, k=60)
    texts = []
    for _ in range(150):
        own = rng.choices(vocab, k=rng.randint(4, 60))
        texts += near_copies(rng, shared + own, rng.choice([1, 1, 1, 2, 5]), 3)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in m.links(make(rows)).collect()}
    want = m.brute_force(rows)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {} and max(n for _, n in want.values()) > 5


def test_columns_of_any_names(make):
    rows = make([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y")]).withColumnRenamed("key", "__id").withColumnRenamed("row", "class_hash")
    kept = m.keep_one(rows)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_odd_rows(make, odd):
    got = m.links(odd).collect()
    assert len(got) == odd.count()
    of = {r["doc_id"]: r for r in got}
    assert of[5]["class_id"] == 4 and of[5]["n_links"] == 1 and of[8]["copy_of"] == 7
    assert of[1]["n_links"] == 0 and of[2]["class_id"] == 2 and of[6]["n_links"] == 0
    assert [r["n_links"] for r in got if r["doc_id"] == 3] == [1, 1]


def test_empty(make):
    assert m.links(make([])).collect() == []


def test_bands_reach_recall():
    for t in (0.5, 0.8, 0.9):
        b, r = m.bands_and_rows(t, 0.99)
        assert 1 - (1 - t**r) ** b >= 0.99 and b * r <= 128


def test_overlaps_as_sets():
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(0, 500, size=rng.integers(1, 200))) for _ in range(30)]
    for i, j, shared in m.overlaps(lists):
        for a in range(shared.shape[0]):
            for b in range(shared.shape[1]):
                assert i + a == j + b or shared[a, b] == len(np.intersect1d(lists[i + a], lists[j + b]))


def test_documents_without_an_id_are_linked(make):
    words = [f"word{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(words[:-1]), " ".join(reversed(words))
    for ids in ((None, None), (None, 5), (5, None)):
        rows = m.links(make([(ids[0], a), (ids[1], b), (9, c)])).collect()
        assert sorted(r["n_links"] for r in rows) == [0, 1, 1]
        assert {r["class_id"] for r in rows if r["n_links"]} == {5 if 5 in ids else None}
        kept = m.keep_one(make([(ids[0], a), (ids[1], b), (9, c), (9, c)])).collect()
        assert len(kept) == 2 and {r["doc_id"] for r in kept} == {9, 5 if 5 in ids else None}
    assert len(m.keep_one(make([(None, a), (None, a), (None, b), (None, "..."), (None, "...")])).collect()) == 2
