import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from bazaar.llm import spelling
from bazaar.llm.spelling import Neighbours, count_words, group_variants, hashed, near_words, variant


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_force(counts, times=10):
    near = {w: [v for v in counts if v != w and one_apart(w, v)] for w in counts}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_every_neighbour_is_made_once_at_least():
    alphabet = "abé"
    made = Neighbours(alphabet)
    words = ["abé", "aab", "bbb"]
    codes = spelling._codes(words)
    of = lambda w: int(spelling.mix(made.running(spelling._codes([w]))[:, -1])[0])
    got = {w: set() for w in words}
    for _, _, h in made.of(codes):
        for w, row in zip(words, h, strict=True):
            got[w] |= set(row.ravel().tolist())
    for w in words:
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        assert got[w] == {of(x) for x in want}


def test_slices_of_places_give_the_same(monkeypatch):
    codes = spelling._codes(["abcdefghij" * 3])
    whole = [np.concatenate([h.ravel() for e, _, h in Neighbours("abc").of(codes) if e == k]) for k in range(3)]
    monkeypatch.setattr(spelling, "TOGETHER", 20)
    for k in range(3):
        assert (np.concatenate([h.ravel() for e, _, h in Neighbours("abc").of(codes) if e == k]) == whole[k]).all()


def test_like_brute_force(spark):
    pick = random.Random(5)
    words = set()
    while len(words) < 300:
        w = "".join(pick.choice("abÿ") for _ in range(pick.randint(4, 7)))
        words |= {w, w[:2] + w[3:], w + "c"}
    counts = {w: pick.choice([2, 3, 20, 30, 400, 5000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in group_variants(df).collect()]
    want = brute_force(counts)
    assert sorted(got, key=str) == want and any(r[1] and r[2] != r[1] for r in want)
    # a filter that lets everything through, and one word for each hash: the join alone decides
    pairs = {(r["word"], r["near"]) for r in near_words(hashed(df)).collect()}
    assert pairs == {(a, b) for a in words for b in words if a != b and one_apart(a, b)}


def test_a_full_filter_loses_and_adds_nothing(spark, monkeypatch):
    df = spark.createDataFrame([("hallodu", 50), ("hallidu", 3), ("halodu", 4), ("fernweh", 9)], "word string, n long")
    monkeypatch.setattr(spelling, "word_filter", lambda words, n: np.full(1 << 10, ~np.uint64(0)))
    assert {(r["word"], r["near"]) for r in near_words(hashed(df)).collect()} == {("hallodu", "hallidu"), ("hallidu", "hallodu"), ("hallodu", "halodu"), ("halodu", "hallodu")}


def test_words_of_documents(spark, make, odd):
    rows = [(i, "Überaus straßenbahn Straßenbahn ABCDEFGHI x " * 3) for i in range(60)] + [(60, None), (61, ""), (61, "kürzere÷kürzere×wörter")]
    docs = make(rows)
    want = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{d}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 7:
                want[low] += 1
    assert {r["word"]: r["n"] for r in count_words(docs, variant).collect()} == dict(want)
    assert any(w.startswith("stra") and len(w) < 11 for w in want)
    assert {r["word"]: r["n"] for r in count_words(odd).collect()} == {}


def test_very_long_words(spark):
    long = "langeswort" * 3000
    df = spark.createDataFrame([(long, 100), (long[:-1], 3), (long[:5000] + "x" + long[5001:], 2)], "word string, n long")
    got = {len(r["word"]) * 10 + r["n"] % 10: r for r in group_variants(df).collect()}
    assert all(r["root"] == long for r in got.values()) and sorted(r["n_near"] for r in got.values()) == [1, 1, 2]


def test_empty_tables(spark, make):
    assert count_words(make([])).collect() == []
    assert group_variants(spark.createDataFrame([], "word string, n long")).collect() == []
    alone = group_variants(spark.createDataFrame([("einzelnes", 2)], "word string, n long")).collect()
    assert [tuple(r) for r in alone] == [("einzelnes", None, "einzelnes", 2, 0, None)]
