"""Spelling variants: words that differ by one code point, each under the far more frequent one it may be a slip of.

The full neighbourhood of every word is generated: all deletions, and all replacements and insertions over the observed
alphabet. Neighbours are numbers at first: the polynomial hash of each follows from the running hashes of its word, for
all words of a length at once. A filter of the vocabulary's hashes (of bounded size) stops most that are no words; the
rest, with the edit that made them, are joined to the vocabulary by hash and held against the word that they met there:
an equality of whole words, so no distance is computed, and a hash that two words share does no harm.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import release, staged
from bazaar.llm.sharding import _BYTE_CRC
from bazaar.llm.words import mix

#: Least code points of a word, least occurrences.
SHORTEST, LEAST = 7, 2
#: How many times as frequent a form must be as its variant.
TIMES = 10
#: Bits of the filter for each word, probes, and bits at most (32 MB): with more words than that serves, more neighbours
#: are joined that are no words, up to all of them; the result is the same.
BITS, PROBES, MOST_BITS = 16, 3, 1 << 28
#: Words that a task counts before it lets go of them; neighbours handled at once.
COUNTED, TOGETHER = 200_000, 1 << 20

_LOWER = {c: c + 32 for c in range(65, 91)}
_B = 0xC2B2AE3D27D4EB4F
_INVERSE = np.uint64(pow(_B, -1, 1 << 64))
DELETE, REPLACE, INSERT = range(3)


def variant(doc_id: object, run: str) -> str:
    """The run, or what a slip of the pen makes of it: one of 31 runs of a document, by the CRC of both, lacks a code point."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, slip=None, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(word, n): maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, changed by ``slip``
    (of id and run; default: not at all), of ``shortest`` code points at least then, with their occurrences. Null texts
    have none; documents are counted as often as they stand in the table."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = Counter(runs.findall((t.as_py() or "").translate(_LOWER)))
                if slip:
                    for w, n in own.items():
                        counts[slip(d, w)] += n
                else:
                    counts.update(own)
                if len(counts) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    parts = docs.select(doc_id, text).mapInArrow(run, "word string, n long")
    return parts.where(F.char_length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n"))


class Neighbours:
    """Hashes of all words that differ from given ones by one code point of the alphabet."""

    def __init__(self, alphabet: str):
        self.alphabet = np.array([ord(c) for c in alphabet], dtype=np.uint32)
        self.up = np.ones(1, np.uint64)

    def value(self, codes: np.ndarray) -> np.ndarray:
        return mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def powers(self, n: int) -> np.ndarray:
        if len(self.up) <= n:
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _B, np.uint64)]))
        return self.up

    def running(self, codes: np.ndarray) -> np.ndarray:
        """(words, length + 1): the sums of value * B ** place up to each place."""
        m, n = codes.shape
        out = np.zeros((m, n + 1), np.uint64)
        np.cumsum(self.value(codes) * self.powers(n)[:n], axis=1, out=out[:, 1:])
        return out

    def of(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(edit, first place, hashes) of words of one length: an array (words, places) for deletions, else (words,
        places, alphabet). What leaves a word as it is has the word's own hash."""
        m, n = codes.shape
        sums, values, letters, up = self.running(codes), self.value(codes), self.value(self.alphabet), self.powers(n)
        whole = sums[:, -1:]
        with np.errstate(over="ignore"):
            step = max(1, TOGETHER // (m * max(1, len(letters))))
            for lo in range(0, n, step * max(1, len(letters))):
                at = slice(lo, min(n, lo + step * max(1, len(letters))))
                yield DELETE, lo, mix(sums[:, :-1][:, at] + (whole - sums[:, 1:][:, at]) * _INVERSE)
            for lo in range(0, n + 1, step):
                at = slice(lo, min(n + 1, lo + step))
                put = letters[None, :] * up[at, None]
                before = sums[:, at]
                yield INSERT, lo, mix((before + (whole - before) * np.uint64(_B))[:, :, None] + put[None])
                at = slice(lo, min(n, lo + step))
                if at.start < at.stop:
                    rest = whole - values[:, at] * up[at]
                    yield REPLACE, lo, mix(rest[:, :, None] + (letters[None, :] * up[at, None])[None])


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)


def _by_length(words: list[str], alphabet: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, codes) of words of one length, few enough for TOGETHER neighbours, or one."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        few = max(1, TOGETHER // (int(n + 1) * max(1, alphabet)))
        for lo in range(0, len(at), few):
            some = at[lo : lo + few]
            yield some, _codes([words[i] for i in some])


def hashed(words: DataFrame) -> DataFrame:
    """words (a column ``word``, none empty, none null) plus ``h``, the hash that Neighbours gives."""
    names = words.columns
    at = names.index("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Neighbours("")
        for b in batches:
            found, h = b.column(at).to_pylist(), np.zeros(b.num_rows, np.uint64)
            for some, codes in _by_length(found, 1):
                h[some] = mix(made.running(codes)[:, -1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h.view(np.int64))], names=[*names, "h"])

    return words.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema) + ", h long")


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    first, step = h & np.uint64(bits - 1), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (first + np.uint64(i) * step) & np.uint64(bits - 1)


def word_filter(words: DataFrame, n_words: int) -> np.ndarray:
    """Bits set at the probes of each h of words: made by tasks, combined by Spark, at most MOST_BITS on the driver."""
    bits = min(MOST_BITS, 1 << max(16, (BITS * n_words - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(np.concatenate(list(_probes(b.column(0).to_numpy().view(np.uint64), bits))))
            slot, first = np.unique(p >> np.uint64(6), return_index=True)
            one = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first) if len(p) else p
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(one.view(np.int64))], names=["slot", "bits"])

    made = words.select("h").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[made.column("slot").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return out


def _edited(word: Column, edit: Column, place: Column, letter: Column) -> Column:
    """word after the edit; place from 0."""
    behind = F.when(edit == INSERT, place).otherwise(place + 1)
    return F.concat(F.substring(word, F.lit(1), place), F.when(edit == DELETE, F.lit("")).otherwise(letter), F.substring(word, behind + 1, F.char_length(word)))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of different words of the vocabulary (word, n, h: see hashed) one inserted,
    deleted or replaced code point apart, in both directions."""
    spark = vocabulary.sparkSession
    alphabet = "".join(sorted(r[0] for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()))
    shared = spark.sparkContext.broadcast((alphabet, word_filter(vocabulary, vocabulary.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, bits = shared.value
        made = Neighbours(letters)
        for b in batches:
            words, own = b.column(0).to_pylist(), b.column(1).to_numpy().view(np.uint64)
            for some, codes in _by_length(words, len(letters)):
                parts = []
                for edit, lo, h in made.of(codes):
                    shape, left, flat = h.shape, None, h.ravel()
                    for p in _probes(flat, len(bits) << 6):
                        p = p if left is None else p[left]
                        hit = (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0
                        left = np.flatnonzero(hit) if left is None else left[hit]
                    at = np.unravel_index(left, shape)
                    other = flat[left] != own[some[at[0]]]
                    parts.append((flat[left], at[0], np.full(len(left), edit), at[1] + lo, at[2] if len(at) > 2 else np.zeros(len(left), np.int64)))
                    parts[-1] = tuple(x[other] for x in parts[-1])
                h, row, edit, place, letter = (np.concatenate(x) for x in zip(*parts, strict=True))
                # an edit for each neighbour: several may make the same one
                _, first = np.unique(np.stack([row.astype(np.uint64), h]), axis=1, return_index=True)
                chars = pa.array(list(letters) or [""], pa.string()).take(pa.array(letter[first]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(own[some[row[first]]].view(np.int64)), pa.array(h[first].view(np.int64)), pa.array(edit[first], pa.int32()), pa.array(place[first], pa.int32()), chars,
                ], names=["h", "near_h", "edit", "place", "letter"])

    tried = vocabulary.select("word", "h").mapInArrow(run, "h long, near_h long, edit int, place int, letter string")
    met = tried.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("h").alias("near_h")), "near_h").join(vocabulary, "h")
    same = _edited(F.col("word"), F.col("edit"), F.col("place"), F.col("letter")) == F.col("near")
    return met.where(same).select("word", "n", "near", "near_n")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words (word, n; words distinct, none null) plus form, root, n_near, form_n.

    form: of the near words (see near_words) the most frequent, of those that tie the least in code-point order, if it
    is ``times`` as frequent as the word or more; else null. root: what following forms ends in, the word itself without
    one. n_near: how many near words there are; form_n: the form's n. Empty tables give empty ones.
    """
    # dealt out anew: the vocabulary is small for the tasks' work, and words of a letter stand together after a sort
    vocabulary = staged(hashed(words.repartition("word")), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = staged(near_words(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), best), "near")
    formed = near.select("word", "n", "n_near", F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"))
    links = staged(formed.where("f is not null").select("word", F.col("f.form").alias("root")), "links")
    # a form is ``times`` as frequent, so 64-bit counts allow few steps; each round doubles those taken
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        more = not moved.where("moved").isEmpty()
        release(links)
        links = moved.drop("moved")
        if not more:
            break
    rows = vocabulary.select("word", "n").join(formed.drop("n"), "word", "left").join(links, "word", "left")
    return rows.select("word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("f.form_n").alias("form_n"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_variants(count_words(docs, variant).where(F.col("n") >= LEAST))


OP11_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, {_BYTE_CRC} AS c FROM range(0, 256) r(i))),
     runs AS (SELECT doc_id, run, count(*) AS c, coalesce(doc_id::VARCHAR, '') || ':' || run AS k
              FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY doc_id, run),
     h AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda b: ('0x' || b)::BIGINT)),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM runs, crc),
     w AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
     cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)),
     near AS (SELECT cut.word, w.word AS near FROM cut JOIN w ON d = w.word UNION SELECT w.word, cut.word FROM cut JOIN w ON d = w.word
              UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.word <> b.word),
     ranked AS (SELECT near.word, near, w.n AS near_n, v.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near) AS place
                FROM near JOIN w ON near = w.word JOIN w v ON near.word = v.word),
     f AS (SELECT word, n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM ranked WHERE place = 1),
     walk AS (SELECT word, word AS root FROM w UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL),
     last AS (SELECT walk.word, root FROM walk LEFT JOIN f ON root = f.word WHERE f.form IS NULL)
SELECT w.word, form, root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n FROM w LEFT JOIN f ON w.word = f.word JOIN last ON w.word = last.word
"""
