"""Language identification by word-first backoff.

A word seen in training scores its log frequency in each language. An unseen word falls back to its
character n-grams: the longest order of which any n-gram is known, scored by the mean of the known ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import staged
from bazaar.llm.words import CHUNK, Index, mix, powers

#: Orders of n-grams after words (level 0), longest first; a word's bounds count as characters.
ORDERS = (5, 4, 3, 2, 1)
#: Documents that train, at most about.
TRAIN_DOCS = 12_000
_P = 0x9E3779B97F4A7C15


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter; its value in hashes, the same for all that isn't."""
    letter = np.array([chr(i).isalpha() for i in range(0x110000)])
    value = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_P))
    value[~letter] = value[0x20]
    return letter, value


class Batch:
    """Words of some texts, lower-cased, as hashes, and n-grams of chosen ones."""

    def __init__(self, texts: list[str | None]):
        letter, value = _letters()
        low = [(t or "").lower() for t in texts]
        points = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offsets = np.cumsum([1, *(len(t) + 1 for t in low)])
        inside = letter[points]
        step = np.diff(inside.astype(np.int8))
        self.start, self.end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        up, self.down = powers(_P, len(points))
        self.sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(value[points] * up[: len(points)], out=self.sums[1:])
        self.rows = len(texts)

    def words(self) -> np.ndarray:
        return mix((self.sums[self.end] - self.sums[self.start]) * self.down[self.start])

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in words, hash) of each n-gram of those words, one character beyond either bound included."""
        pad = 0 if n == 1 else 1
        first = self.start[words] - pad
        count = np.maximum(self.end[words] + pad - n - first + 1, 0)
        which = np.repeat(np.arange(len(words)), count)
        at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]
        return which, mix((self.sums[at + n] - self.sums[at]) * self.down[at])


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK characters."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


@dataclass
class Model:
    """langs, and for each level the known keys with a row of log frequencies for each."""

    langs: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]

    def indexes(self) -> list[Index]:
        return [Index(k) for k in self.keys]


def fit(docs: DataFrame, max_docs: int = TRAIN_DOCS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Counts words and n-grams by language in about max_docs documents chosen by a hash of doc_id.

    The bound is on the sample that the classifier learns from; null lang or text don't train, repeated rows count each
    time, other columns are not read. Counting is distributed; all that the sample holds goes to the model, in one piece.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = known.count()
    share = min(1.0, max_docs / n) if n else 1.0
    sample = known if share == 1 else known.filter(F.pmod(F.xxhash64(F.col(doc_id), F.lit("langid")), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs], dtype=np.uint64)
            for lo, hi in batches_of(texts):
                words = Batch(texts[lo:hi])
                by = of[lo:hi][words.row]
                for level, order in enumerate((0, *ORDERS)):
                    if order:
                        which, h = words.grams(np.arange(len(words.row)), order)
                        own = by[which]
                    else:
                        h, own = words.words(), by
                    for i, name in enumerate(names):
                        keys, times = np.unique(h[own == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(np.full(len(keys), level, np.int32)), pa.array(keys.view(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "level", "key", "n"])

    counted = sample.select(F.col(text), F.col(lang).cast("string")).mapInArrow(count, "lang string, level int, key long, n long")
    counts = staged(counted.groupBy("lang", "level", "key").agg(F.sum("n").alias("n")), "counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).cast("int").alias(f"l{i}") for i, x in enumerate(langs)]
    found = counts.groupBy("level", "key").agg(*by_lang or [F.count("*").alias("l0")]).toArrow()
    level, key = found.column("level").to_numpy(), found.column("key").to_numpy().view(np.uint64)
    times = np.stack([found.column(f"l{i}").to_numpy() for i in range(len(langs))], axis=1) if langs else np.zeros((0, 0))
    keys, logs = [], []
    for i in range(len(ORDERS) + 1):
        own = np.flatnonzero(level == i)
        own = own[np.argsort(key[own])]
        keys.append(key[own])
        logs.append(np.log((times[own] + 0.5) / (times[own].sum(axis=0) + 0.5 * (len(own) + 1))))
    return Model(langs, keys, logs)


def scores(model: Model, indexes: list[Index], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(sums of log frequencies by language, number of words) of each text."""
    words = Batch(texts)
    out = np.zeros((words.rows, len(model.langs)))
    left, h = np.arange(len(words.row)), words.words()
    for level, order in enumerate((0, *ORDERS)):
        if order:
            which, h = words.grams(left, order)
        else:
            which = left
        place = indexes[level].find(h)
        hit = place >= 0
        which, place = which[hit], place[hit]
        known = np.bincount(which, minlength=len(left))
        got = known > 0
        for i in range(len(model.langs)):
            sums = np.bincount(which, weights=model.logs[level][place, i], minlength=len(left))
            out[:, i] += np.bincount(words.row[left[got]], weights=sums[got] / known[got], minlength=words.rows)
        left = left[~got]
        if not len(left):
            break
    return out, np.bincount(words.row, minlength=words.rows)


def detect(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the language of each whole text, and its share of the likelihood (0 to 1).

    A text that is null or has no letter, or any text if nothing was learnt, is ``und`` with score 0. A text of
    letters of which no n-gram is known gets the first language with score 1 / number of languages. Ties go to
    the first language by name. Every row has a result, repeated ones too; other columns are not read, whatever
    their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        indexes = own.indexes()
        for b in batches:
            texts, preds, values = b.column(1).to_pylist(), [], []
            for lo, hi in batches_of(texts):
                s, n = scores(own, indexes, texts[lo:hi])
                if not own.langs:
                    n = np.zeros(hi - lo)
                    s = np.zeros((hi - lo, 1))
                best = s.argmax(axis=1)
                share = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                preds += [own.langs[i] if k else "und" for i, k in zip(best, n, strict=True)]
                values += np.where(n > 0, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(values, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32(doc_id as text) mod 4 is 2. A null doc_id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return detect(docs, fit(docs.filter(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))



# the sample is whole up to TRAIN_DOCS rows: there SQL can follow
OP1_SQL = rf"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) r(i))),
     d AS (SELECT doc_id, text, lang, coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda b: ascii(b)::BIGINT)),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 4 = 2, false) AS held_out FROM documents, crc),
     wc AS (SELECT doc_id, w, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM d) GROUP BY doc_id, w),
     g AS (SELECT w, n, unnest(CASE WHEN n = 1 THEN string_split(w, '') ELSE list_transform(range(1, length(w) + 4 - n), lambda i: substr(' ' || w || ' ', i, n)) END) AS k
           FROM (SELECT DISTINCT w FROM wc), (SELECT unnest({list(ORDERS)}) AS n)),
     tc AS (SELECT lang, w, sum(m) AS m FROM wc JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, w),
     c AS (SELECT 0 AS n, w AS k, lang, m AS c FROM tc UNION ALL SELECT n, k, lang, sum(m) FROM tc JOIN g USING (w) GROUP BY n, k, lang),
     langs AS (SELECT DISTINCT lang FROM c), keys AS (SELECT DISTINCT n, k FROM c),
     z AS (SELECT n, lang, coalesce(t, 0) + 0.5::DOUBLE * (e + 1) AS z FROM (SELECT n, count(*) AS e FROM keys GROUP BY n) CROSS JOIN langs LEFT JOIN (SELECT n, lang, sum(c) AS t FROM c GROUP BY n, lang) USING (n, lang)),
     l AS (SELECT keys.n, keys.k, z.lang, ln((coalesce(c.c, 0) + 0.5::DOUBLE) / z) AS l FROM keys JOIN z USING (n) LEFT JOIN c ON c.n = keys.n AND c.k = keys.k AND c.lang = z.lang),
     unseen AS (SELECT g.w, g.n, lang, avg(l) AS s FROM g JOIN l ON l.n = g.n AND l.k = g.k WHERE g.w NOT IN (SELECT k FROM keys WHERE n = 0) GROUP BY g.w, g.n, lang),
     ws AS (SELECT w, lang, arg_max(s, n) AS s FROM unseen GROUP BY w, lang UNION ALL SELECT k, lang, l FROM l WHERE n = 0),
     s AS (SELECT doc_id, langs.lang, sum(m * coalesce(s, 0)) AS s FROM wc CROSS JOIN langs LEFT JOIN ws ON ws.w = wc.w AND ws.lang = langs.lang GROUP BY doc_id, langs.lang),
     b AS (SELECT doc_id, first(lang ORDER BY s DESC, lang) AS best, 1 / sum(exp(s - top)) AS share FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS top FROM s) GROUP BY doc_id)
SELECT d.doc_id, held_out, coalesce(best, 'und') AS lang_pred, coalesce(round(share, 6), 0::DOUBLE) AS score FROM d LEFT JOIN b USING (doc_id)
"""
