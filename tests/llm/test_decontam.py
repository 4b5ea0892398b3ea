import random

import pytest

from bazaar.llm import decontam as m


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "ß"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 25)))) for i in range(25)] + [(90, "W1, w2"), (91, None), (92, "--"), (93, "W1, w2")]
    docs = []
    for _ in range(120):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(items[:25])[1].split()
            lo = rng.randint(0, max(0, len(words) - 10))
            parts += [rng.choice(["; ", " ", "\n"]).join(words[lo : lo + rng.randint(8, 14)]).upper(), rng.choice(["", "w1 w2", "x"])]
        docs.append(" ".join(parts))
    return list(enumerate([*docs, None, "", "!!"])), items


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, make, seed):
    docs, items = corpus(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = m.scan(make(docs), bench).collect()
    assert len(rows) == len(docs)
    import hashlib

    for r in rows:
        ids = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        text = dict(docs)[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], len(r["items"]), ids) == m.brute_force(text, items)
        assert sum(len(m.words_of(text[s.start : s.end])) for s in r["spans"]) == r["n_hit"]
    clean = {r["doc_id"] for r in m.keep_clean(make(docs), bench).collect()}
    assert clean == {r["doc_id"] for r in rows if not r["n_hit"]}


def test_odd_rows(spark, make, odd):
    bench = spark.createDataFrame([(1, "tie tie tie"), (2, "CAFÉ école"), (None, None)], "item_id long, text string")
    got = {(r["doc_id"], r["n_hit"]) for r in m.scan(odd, bench).collect()}
    assert {(7, 3), (8, 3), (1, 0), (2, 0), (6, 0)} <= got
    assert m.keep_clean(odd, bench).columns == odd.columns
    assert m.scan(make([]), bench).collect() == [] and m.scan(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_items_without_an_id_and_offsets(spark, make):
    items = spark.createDataFrame([(None, "one two three"), ("b", "three four")], "item_id string, text string")
    (row,) = m.scan(make([(1, "É one TWO three four 𝒳 one two three")]), items).collect()
    assert row["items"] == ["b"] and row["n_hit"] == 7
    assert ["É one TWO three four 𝒳 one two three"[s["start"] : s["end"]] for s in row["spans"]] == ["one TWO three four", "one two three"]
    (row,) = m.scan(make([(1, "one two three")]), items, offsets=False).collect()
    assert row["spans"] is None and row["n_hit"] == 3
    many = "three four " * 8000
    assert len(m.original_spans(many, [(2 * i, 2 * i + 2) for i in range(8000)])) == 8000
