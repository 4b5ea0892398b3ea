import random
import zlib
from collections import defaultdict

import pytest

from bazaar.llm import sharding as m


def corpus(seed, n=500):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("abcé ", k=rng.randint(0, 200))) for _ in range(n)]
    return list(enumerate(texts + [texts[3]] * 40 + ["hot" * 30] * 400))


def slots(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_bytes(make):
    docs = corpus(1)
    rows = m.shard_by_bytes(make(docs), 8).collect()
    texts = dict(docs)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    total = defaultdict(int)
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 8, zlib.crc32(body))
        total[r["shard"]] += r["size"]
    slots(rows)
    target = sum(total.values()) / 8
    assert set(total) == set(range(8)) and max(abs(t - target) for t in total.values()) <= 0.05 * target + 420
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    # only groups that lie on a cut are in more shards than one
    assert sum(len(s) - 1 for s in where.values()) <= 7


def test_in_order(make):
    docs = corpus(2, 200)
    rows = sorted(m.shard_by_bytes(make(docs), 5, order=["doc_id"]).collect(), key=lambda r: r["doc_id"])
    assert [(r["shard"], r["slot"]) for r in rows] == sorted((r["shard"], r["slot"]) for r in rows)
    slots(rows)


def test_law_does_not_depend_on_partitions(make):
    docs = corpus(3, 150)
    a, b = (sorted(map(tuple, m.shard_by_bytes(make(docs).repartition(n), 7).collect())) for n in (1, 9))
    assert a == b


@pytest.mark.parametrize("n", [1, 3, 50])
def test_odd_rows(make, odd, n):
    rows = m.shard_by_bytes(odd, n).collect()
    assert len(rows) == odd.count() and {r["shard"] for r in rows} <= set(range(n))
    slots(rows)
    assert m.shard_by_bytes(make([]), n).collect() == []
