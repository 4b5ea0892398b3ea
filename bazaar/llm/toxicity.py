"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled ones (U) train linear classifiers. With class prior p and sigmoid
loss l(z) = 1 / (1 + exp(z)) the risk is  p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]):  the second term, an
estimate of the risk on clean text, can't be negative in truth, so where it falls below zero the step goes the
other way. That loss is bounded, so a slip in the prior doesn't count the more the surer f is; but it has flat
places, so training starts with the logistic loss, which has none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import free
from bazaar.llm.langid import held_out
from bazaar.llm.words import NOT_ALNUM, Index, chunks, hashes, mix, spans

#: Confirmed toxic and unlabelled texts that train, at most about.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 10_000
#: Bytes of a word's beginnings that are features beside the word.
BEGINNINGS = (4, 6, 8)
#: Standard errors by which a feature's rate in P is over that in U where it enters at half its value, and how steeply
#: that rises. What is rarer in P tells of length and language, not of clean text.
HALF_Z, STEEP_Z = 4.0, 2.0
#: Jaccard similarity of features, as a fraction, from which a text that trains is a near copy.
COPY = 4, 5
MEMBERS, EPOCHS, BATCH, RATE, DECAY = 2, 60, 512, 0.05, 1e-5


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 32-bit key) of each word and of its beginnings, over lower-cased text."""
    row, start, end = spans(raw, offsets, NOT_ALNUM)
    keys, rows = [hashes(raw, start, end)], [row]
    for i, n in enumerate(BEGINNINGS):
        long = end - start > n
        keys.append(hashes(raw, start[long], start[long] + n) ^ np.uint64(0x5BD1E995 * (i + 1)))
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(keys).astype(np.uint32)


@dataclass
class Model:
    """Weights of the features in keys; value: sigmoid(bias + sum over the features present)."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


def _numbered(docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys of sets of keys, sorted, and each set as places in them: views of one array, as memory of many
    small ones isn't given back."""
    keys = np.unique(np.concatenate(docs))
    ends = np.cumsum([len(d) for d in docs])
    places = np.split(np.empty(ends[-1], np.int32), ends[:-1])
    for d, at in zip(docs, places, strict=True):
        at[:] = np.searchsorted(keys, d)
    return keys, places


def _counts(sets: list[np.ndarray], n: int) -> np.ndarray:
    """How many of the sets have each of n places."""
    out = np.zeros(n, np.int32)
    for at in sets:
        out[at] += 1
    return out


def one_of_copies(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Without those with a Jaccard similarity of COPY or more to an earlier one that stays: near copies must not count
    as evidence.

    docs are sets of keys. No such pair is missed: the n - ceil(COPY * n) + 1 rarest keys of one hold a key of those of
    the other, so texts are compared, on all their keys, where these meet.
    """
    if not docs:
        return []
    keys, places = _numbered(docs)
    count = _counts(places, len(keys))
    rank = np.empty(len(keys), np.int32)
    rank[np.lexsort((keys, count))] = np.arange(len(keys))
    num, den = COPY
    sizes = np.array([len(at) for at in places])
    rarest = sizes - -(-num * sizes // den) + 1
    room = np.zeros(len(keys) + 1, np.int64)
    for at, n in zip(places, rarest, strict=True):
        at[:] = np.sort(rank[at])
        room[at[:n] + 1] += 1
    # the texts that stay, by each of their rarest keys: from room[key], held[key] of them
    room = np.cumsum(room)
    met, held = np.empty(room[-1], np.int32), np.zeros(len(keys), np.int32)
    own, out, empty = np.zeros(len(keys), bool), [], False
    for i, (doc, at, n) in enumerate(zip(docs, places, sizes, strict=True)):
        few = at[: rarest[i]]
        times = held[few]
        near = np.unique(met[np.repeat(room[few] - np.cumsum(times) + times, times) + np.arange(times.sum())])
        near = near[(num * n <= den * sizes[near]) & (num * sizes[near] <= den * n)]
        own[at] = True
        copy = not n and empty
        for lo in range(0, len(near), 256):
            some = near[lo : lo + 256]
            both = np.add.reduceat(own[np.concatenate([places[j] for j in some])], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            copy = bool((den * both >= num * (n + sizes[some] - both)).any())
            if copy:
                break
        own[at] = False
        if copy:
            continue
        empty |= not n
        met[room[few] + times] = i
        held[few] += 1
        out.append(doc)
    return out


def train(p: list[np.ndarray], u: list[np.ndarray], prior: float, seed: int = 0) -> Model:
    """Classifiers from the distinct feature keys of P and U texts; the mean of their weights.

    No P, no U or a prior of 0: every score is the prior.
    """
    prior = min(max(prior, 0.0), 0.999)
    p, u = one_of_copies(p), one_of_copies(u)
    if not p or not u or not prior:
        return Model(np.zeros(0, np.uint32), np.zeros(0, np.float32), float(np.log(max(prior, 1e-9) / (1 - prior))))
    n_p = len(p)
    keys, rows = _numbered([*p, *u])
    del p, u
    x_p, x_u = rows[:n_p], rows[n_p:]
    value = values(_counts(x_p, len(keys)), _counts(x_u, len(keys)), len(x_p), len(x_u))
    rng = np.random.default_rng(seed)
    weights, biases = [], []
    for m in range(MEMBERS):
        own_u = x_u if len(x_u) < 2 * MEMBERS else [x_u[i] for i in range(len(x_u)) if i % (MEMBERS + 1) != m]
        w, b = fit_one(x_p, own_u, value, prior, rng)
        weights.append(w * value)
        biases.append(b)
    return Model(keys.astype(np.uint32), np.mean(weights, axis=0, dtype=np.float32), float(np.mean(biases)))


def values(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """What a feature counts for where it is present, 0 to 1, from the numbers of texts that have it: the more, the surer
    it is that it is more frequent in P. Every feature enters; one seen once counts for little."""
    expected = n_p * (in_u + 0.5) / (n_u + 1)
    z = (in_p - expected) / np.sqrt(expected + 1)
    return 1 / (1 + np.exp(-np.clip(STEEP_Z * (z - HALF_Z), -40, 40)))


def risk(f_p: np.ndarray, f_u: np.ndarray, prior: float, logistic: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """(the estimate of the risk on clean text, descent slopes of the non-negative risk by each f of P and U)."""
    sig_p, sig_u = 1 / (1 + np.exp(-np.clip(f_p, -40, 40))), 1 / (1 + np.exp(-np.clip(f_u, -40, 40)))
    if logistic:  # slopes of l(f), l(-f)
        up_p, down_p, down_u = sig_p - 1, sig_p, sig_u
        clean = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
    else:
        up_p, down_p, down_u = -sig_p * (1 - sig_p), sig_p * (1 - sig_p), sig_u * (1 - sig_u)
        clean = sig_u.mean() - prior * sig_p.mean()
    if clean >= 0:  # of the whole risk
        return clean, prior * (up_p - down_p) / len(f_p), down_u / len(f_u)
    return clean, prior * down_p / len(f_p), -down_u / len(f_u)  # up the estimate that went below zero


def fit_one(x_p: list[np.ndarray], x_u: list[np.ndarray], value: np.ndarray, prior: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """One classifier by Adam on batches that hold P and U in proportion; f is the bias plus the sum of weight * value."""
    n = len(value)
    w, m, v = (np.zeros(n + 1, np.float32) for _ in range(3))
    value, full, step = value.astype(np.float32), np.empty(n, np.float32), np.empty(n + 1, np.float32)
    w[n] = np.log(prior / (1 - prior))
    steps = max(1, -(-len(x_u) // BATCH))
    t, epochs = 0, max(EPOCHS, 600 // steps)
    for epoch in range(epochs):
        perm_p, perm_u = rng.permutation(len(x_p)), rng.permutation(len(x_u))
        for s in range(steps):
            own_p, own_u = perm_p[s::steps], perm_u[s::steps]
            if not len(own_p):
                own_p = perm_p
            cols = [np.concatenate([x[i] for i in own]) if len(own) else np.zeros(0, np.int64) for x, own in ((x_p, own_p), (x_u, own_u))]
            rows = [np.repeat(np.arange(len(own)), [len(x[i]) for i in own]) for x, own in ((x_p, own_p), (x_u, own_u))]
            np.multiply(w[:n], value, out=full)
            f_p, f_u = (w[n] + np.bincount(r, weights=full[c], minlength=len(own)) for r, c, own in zip(rows, cols, (own_p, own_u), strict=True))
            _, d_p, d_u = risk(f_p, f_u, prior, epoch < epochs // 10)
            g = np.bincount(np.concatenate(cols), weights=np.concatenate([d_p[rows[0]], d_u[rows[1]]]), minlength=n + 1).astype(np.float32)
            g[:n] *= value
            np.multiply(w, np.float32(DECAY), out=step)
            g[:n] += step[:n]
            g[n] = d_p.sum() + d_u.sum()
            t += 1
            m += np.multiply(np.subtract(g, m, out=step), np.float32(0.1), out=step)
            v += np.multiply(np.subtract(np.multiply(g, g, out=g), v, out=g), np.float32(0.001), out=g)
            rate = RATE * (0.5 * (1 + math.cos(math.pi * epoch / epochs))) / (1 - 0.9**t)
            np.sqrt(np.multiply(v, np.float32(1 / (1 - 0.999**t)), out=g), out=g)
            g += np.float32(1e-8)
            w -= np.multiply(np.divide(m, g, out=step), np.float32(rate), out=step)
    return w[:n], float(w[n])


def fit(docs: DataFrame, toxic: DataFrame, prior: float, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from docs, of which those with a doc_id in ``toxic`` are confirmed; prior: share of toxic texts.

    P is about max_positive of the confirmed, U about max_unlabelled of all docs, labels unseen, both chosen by a
    hash of doc_id: the sample, and with it what goes to the driver (4 bytes for each distinct feature of a text), is
    bounded. Null texts and empty ones have no features; repeated rows are near copies of each other, so one trains;
    other columns are not read, whatever their names.
    """
    ids = toxic.select(F.col(doc_id).alias("_id")).filter("_id is not null").distinct()
    part = lambda c, n, most, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1_000_000)) < int(min(1.0, most / max(n, 1)) * 1_000_000)
    chosen = ids.filter(part(F.col("_id"), ids.count(), max_positive, "p")).withColumn("_p", F.lit(True))
    # about max_positive ids, whatever the input
    marked = docs.select(F.col(doc_id).alias("_id"), F.lower(F.col(text)).alias("_text")).join(F.broadcast(chosen), "_id", "left")
    is_u = part(F.col("_id"), docs.count(), max_unlabelled, "u")
    sample = marked.select(F.coalesce("_p", F.lit(False)).alias("p"), F.coalesce(is_u, F.lit(False)).alias("u"), "_text").filter("p or u")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offsets in chunks(b.column(2)):
                row, key = features(raw, offsets)
                pairs = np.unique((row.astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64))
                ends = np.searchsorted(pairs, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(32))
                keys = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))], names=["p", "u", "keys"])

    found = sample.mapInArrow(extract, "p boolean, u boolean, keys array<int>").toArrow()
    keys = [k.values.to_numpy().view(np.uint32) for k in found.column("keys")]
    p, u = found.column("p").to_pylist(), found.column("u").to_pylist()
    # the order in which rows arrive must not matter
    order = sorted(range(len(keys)), key=lambda i: (len(keys[i]), int(np.bitwise_xor.reduce(mix(keys[i].astype(np.uint64))))))
    sets = [[keys[i] for i in order if p[i]], [keys[i] for i in order if u[i]]]
    del found, keys  # train lets go of the sets when it has numbered them
    return train(sets.pop(0), sets.pop(0), prior)


def _scores(own: Model, index: Index, text: pa.Array) -> np.ndarray:
    out = np.full(len(text), own.bias)
    m = max(1, len(own.keys))
    for lo, hi, raw, offsets in chunks(text):
        row, key = features(raw, offsets)
        place = index.find(key)
        hit = np.flatnonzero(place >= 0)
        pairs = np.unique(row[hit].astype(np.int64) * m + place[hit])
        out[lo:hi] += np.bincount(pairs // m, weights=own.weights[pairs % m] if len(own.keys) else None, minlength=hi - lo)
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic) of each whole text, repeated rows each. Null and empty texts
    score by the bias alone. Other columns are not read, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        index = Index(own.keys)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(own, index, b.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col(doc_id), F.lower(F.col(text)).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, score double")


def keep_clean(docs: DataFrame, model: Model, most: float, text: str = "text") -> DataFrame:
    """The rows of docs, all their columns as they are, whose score is under ``most``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        index = Index(own.keys)
        for b in batches:
            low = b.column(b.num_columns - 1)
            kept = pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1])
            yield kept.filter(pa.array(_scores(own, index, low) < most))

    return docs.select("*", F.lower(F.col(text)).alias(free(docs, "low")[0])).mapInArrow(run, docs.schema)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of labels (doc_id, toxic) on the rows that aren't held out; prior: the share of toxic among them.

    Of several labels of one doc_id toxic wins; null labels don't count.
    """
    known = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    return fit(docs.filter(~held_out()), known.filter("toxic = 1"), prior)


#: From this score on a text counts as toxic.
TOXIC = 0.3


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
