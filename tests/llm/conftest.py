import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source); extra columns have clashing names."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", 7) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    long = "long text of very many words " * 4000
    return make([(1, None, None, None), (2, ""), (3, "one"), (3, "one"), (4, long), (5, long), (None, "a text with no id at all"), (6, "!!! ... ???"), (7, "tie tie tie"), (8, "tie tie tie"), (9, "naïve café ÉCOLE 中文 𝒳", "fr", None)])


@pytest.fixture(scope="session")
def toxic_score():
    """(model, text) -> score, word by word: words and their beginnings as a set of hashes that are made byte by byte."""
    import re

    import numpy as np

    from bazaar.llm import toxicity

    full = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    value = [mixed((i + 1) * 0x9E3779B97F4A7C15 & full) for i in range(256)]
    power = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(5000)]

    def key(word, salt=0):
        return (mixed(sum(value[c] * power[i] for i, c in enumerate(word)) & full) ^ salt) & 0xFFFFFFFF

    def score(model, text):
        weight = model.__dict__.setdefault("by_key", dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True)))
        keys = set()
        for w in set(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())):
            keys |= {key(w)} | {key(w[:n], 0x5BD1E995 * (i + 1)) for i, n in enumerate(toxicity.BEGINNINGS) if len(w) > n}
        return 1 / (1 + np.exp(-np.clip(model.bias + sum(weight.get(k, 0) for k in keys), -40, 40)))

    return score
