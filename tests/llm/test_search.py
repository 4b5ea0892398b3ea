import random

import numpy as np
import pytest

from bazaar.llm import search as m
from bazaar.llm.common import staged


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(vocab, odds, k=rng.randint(0, 60))) for _ in range(n)]
    return list(enumerate(texts + texts[:20]))


def check(make, rows, queries, k):
    got = {(r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in m.search(make(rows), make(queries), k).collect()}
    want = m.brute_force(rows, queries, k)
    near = lambda x: {(q, d, r, round(s, 4)) for q, d, r, s in x}
    assert near(got) == near(want)


@pytest.mark.parametrize(("block", "shard", "k"), [(4, 40, 3), (16, 64, 10), (128, 16384, 10)])
def test_as_brute_force(make, monkeypatch, block, shard, k):
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "SPAN", 2)
    monkeypatch.setattr(m, "SHARD_DOCS", shard)
    rows = corpus(k)
    check(make, rows, rows[::15], k)


def test_several_passes(make, monkeypatch):
    monkeypatch.setattr(m, "QUERY_TERMS", 50)
    rows = corpus(4, 80)
    check(make, rows, rows[::9], 5)


def test_odd_rows(make, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = {(r["query_id"], r["doc_id"], r["rank"]) for r in m.search(odd, odd, 2).collect()}
    assert got == {x[:3] for x in m.brute_force(rows, rows, 2)}


def test_empty(make):
    assert m.search(make([]), make([(1, "a")])).collect() == []
    assert m.search(make([(1, "a")]), make([])).collect() == []


def test_blocks_are_pruned():
    import numpy as np

    rng = np.random.default_rng(1)
    docs, terms = [], []
    for d in range(4096):
        for t in set(rng.integers(1, 50, 5)) | ({0} if d < 20 else set()):
            docs.append(d)
            terms.append(t)
    order = np.lexsort((docs, terms))
    docs, terms = np.array(docs, np.int32)[order], np.array(terms, np.uint64)[order]
    names, first = np.unique(terms, return_index=True)
    shard = m.Shard(np.full(4096, 5), names, np.append(first[1:], len(terms)), docs, np.ones(len(docs), np.int32), 5.0, names)
    ends, asked, weights = np.array([0, 2]), np.array([0, 1]), np.array([8.0, 0.1])
    ((q, found, _, read),) = shard.search(ends, asked, weights, 10, np.zeros(1))
    assert q == 0 and set(range(20)) >= set(found.tolist()) and read <= 4 * m.SPAN < shard.blocks
    # a threshold that no bound here reaches leaves the shard out
    assert list(shard.search(ends, asked, weights, 10, np.array([9.0]))) == []


def test_like_documents_are_neighbours(make):
    """Two languages in turn: with their own blocks, a query reads those of one only."""
    import numpy as np

    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"{x}{i}" for i in range(200)], [1 / (i + 1) for i in range(200)], k=30)) for x in "ab" * 600]
    row = m.index(make(list(enumerate(texts))).coalesce(1)).first()
    first = ["ab"[i % 2] for i in row["ids"]]
    assert sum(x != y for x, y in zip(first, first[1:], strict=False)) < 60
    ids, terms, ends, docs = (np.array(row[c]) for c in ("ids", "terms", "ends", "docs"))
    assert all(len(set(docs[a:b])) == b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)) and sorted(ids) == list(range(1200))


def test_a_shard_is_a_file(spark, monkeypatch):
    """Spark reads thousands of rows of a file at once, and a shard is a row of megabytes."""
    monkeypatch.setattr(m, "SHARD_DOCS", 4096)
    made = []
    monkeypatch.setattr(m, "staged", lambda df, name, *rest: made.append((name, staged(df, name, *rest))) or made[-1][1])
    docs = spark.range(0, 10_000, 1, 1).selectExpr("id as doc_id", "concat('all some', id % 3, ' w', id) as text")
    assert m.search(docs, docs.where("doc_id = 77"), 2).orderBy("rank").first()["doc_id"] == 77
    shards = dict(made)["shards"]
    assert shards.count() == 3 == len(shards.inputFiles())


def test_words_of_many_documents_are_rows_of_a_matrix():
    rng = np.random.default_rng(3)
    times = (rng.random((40, 2000)) < np.concatenate([np.full(10, 0.6), np.full(30, 0.02)])[:, None]) * rng.integers(1, 4, (40, 2000))
    term, doc = np.nonzero(times)
    ends = np.cumsum(np.bincount(term, minlength=40))
    names = np.arange(40, dtype=np.uint64)
    shard = m.Shard(np.full(2000, 9), names, ends, doc.astype(np.int32), times[term, doc].astype(np.int32), 9.0, names)
    assert len(shard.matrix) == 10 and len(shard.docs) == (term >= 10).sum()
    tf = times.astype(float)
    weights = rng.random(40)
    scores = np.round((weights[:, None] * tf * (m.K1 + 1) / (tf + m.K1)).sum(axis=0), m.DECIMALS)
    ((_, found, got, _),) = shard.search(np.array([0, 40]), np.arange(40), weights, 10, np.zeros(1))
    assert sorted(got, reverse=True)[:10] == sorted(scores, reverse=True)[:10] and (scores[found] == got).all()


def test_words_of_a_twentieth_are_known_before_a_block_is_read():
    rng = np.random.default_rng(5)
    term, doc = np.nonzero(rng.random((60, 4096)) < 0.05)
    names, weights = np.arange(60, dtype=np.uint64), rng.random(60)
    shard = m.Shard(np.full(4096, 9), names, np.cumsum(np.bincount(term)), doc.astype(np.int32), np.ones(len(doc), np.int32), 9.0, names)
    scores = np.round(np.bincount(doc, weights=weights[term], minlength=4096), m.DECIMALS)
    ((_, found, got, read),) = shard.search(np.array([0, 60]), np.arange(60), weights, 10, np.array([np.sort(scores)[-10]]))
    assert set(np.flatnonzero(scores >= np.sort(scores)[-10])) <= set(found) and (scores[found] == got).all()
    assert read <= 20  # of 256 blocks; by bounds of each word alone nearly all are read


@pytest.mark.parametrize(("numbers", "postings", "together"), [(0, 1, 64), (900, 3000, 64), (1 << 23, 1 << 20, 3), (1 << 23, 1 << 20, 64)])
def test_queries_together_as_each_alone(monkeypatch, numbers, postings, together):
    """Rows of the matrix up to NUMBERS, the rest in lists; scores that single precision can't tell apart keep their order."""
    monkeypatch.setattr(m, "NUMBERS", numbers)
    monkeypatch.setattr(m, "POSTINGS", postings)
    monkeypatch.setattr(m, "TOGETHER", together)
    rng = np.random.default_rng(6)
    term, doc = np.nonzero(rng.random((50, 300)) < np.concatenate([np.full(20, 0.5), np.full(30, 0.01)])[:, None])
    names = np.arange(50, dtype=np.uint64)
    shard = m.Shard(np.full(300, 9), names, np.cumsum(np.bincount(term, minlength=50)), doc.astype(np.int32), np.ones(len(doc), np.int32), 9.0, names)
    assert len(shard.matrix) == min(20, numbers // 300)
    # weights by far more than what tells two documents apart
    weights = np.array([[1e5 + 1e-3 * i if t < 20 else 10.0 * (t % 3 + 1) for t in range(50)] for i in range(20)]) + rng.integers(0, 90, (20, 50)) * 1e-4
    asked = rng.random((20, 50)) < 0.7
    ends = np.concatenate([[0], np.cumsum(asked.sum(axis=1))])
    held = np.zeros((50, 300))
    held[term, doc] = 1
    results = list(shard.search(ends, np.nonzero(asked)[1], weights[asked], 10, np.zeros(20)))
    assert [r[0] for r in results] == list(range(20))
    for q, found, got, _ in results:
        scores = (weights[q] * asked[q]) @ held
        assert np.abs(scores[found] - got).max() < 1e-5
        assert np.abs(np.sort(got)[-10:] - np.sort(scores)[-10:]).max() < 1e-5
