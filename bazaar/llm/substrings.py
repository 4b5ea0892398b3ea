"""Substring deduplication with suffix automata of reference shards.

A word goes if a window of n words around it also starts in a document with a smaller doc_id. Matching every
document against automata of the whole corpus would be quadratic, so the shards hold only what may repeat, and
each document meets only the shards that it may match:

1. Each window has a minimizer, the least hash of its k-grams, so equal windows have equal ones. Keys in two
   documents or more are found by one exchange of packed keys. They only say which shards a document meets.
2. Runs of windows with one such minimizer are segments. Equal segments are one, with the least doc_id. The windows of
   a key of HEAVY_KEY texts or more are segments of their own, with a hash of all their words as a longer key.
3. Segments are dealt out by key to shards of bounded size. A shard's segments, by doc_id, make a generalised suffix
   automaton, each state knowing the first document of its strings; the documents' segments of these keys are streamed
   through it, and their matching statistics of n or more give the first document of every window.
4. These go back to the documents, whose covered words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import by_group, lookup, release, running_sums, staged
from bazaar.llm.words import SPACE, chunks, grams, hashes, mix, spans

#: Words of a minimizer's k-gram.
K = 5
#: Segments of a shard, on average; HEAVY_KEY more at most, for the segments of a key stay together.
SHARD = 4_000
#: A key of so many texts, whatever the size of the corpus, is dealt out window by window.
HEAVY_KEY = 10_000


def segments(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(hash of each word, row of each segment, its first word, its windows, its key, row of each word).

    A segment is a maximal run of windows of n words of one row with the same minimizer.
    """
    row, start, end = spans(raw, offsets, SPACE)
    h = hashes(raw, start, end)
    k = min(K, n)
    wide = n - k + 1
    m = len(h) - n + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return h, none, none, none, np.zeros(0, np.uint64), row
    g = np.full(len(h) - k + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    at, values = grams(h, row, k)
    g[at] = values
    best, where = g[:m].copy(), np.arange(m)
    for j in range(1, wide):
        less = g[j : j + m] < best
        best[less] = g[j : j + m][less]
        where[less] = np.flatnonzero(less) + j
    ok = np.flatnonzero(row[:m] == row[n - 1 :])
    new = np.ones(len(ok), dtype=bool)
    new[1:] = (where[ok][1:] != where[ok][:-1]) | (ok[1:] != ok[:-1] + 1) | (row[ok][1:] != row[ok][:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(ok)]]))
    return h, row[ok[first]], ok[first], count, best[ok[first]], row


class SuffixAutomaton:
    """Generalised over several token strings, added by rising document; states know their first document."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _clone(self, p: int, t, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(link)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        self.first.append(self.first[q])
        while p >= 0 and nxt[p].get(t) == q:
            nxt[p][t] = c
            p = link[p]
        link[q] = c
        return c

    def add(self, tokens, doc) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for t in tokens:
            q = nxt[last].get(t)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, t, q)
                continue
            c = len(link)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            self.first.append(doc)
            p = last
            while p >= 0 and t not in nxt[p]:
                nxt[p][t] = c
                p = link[p]
            if p >= 0:
                q = nxt[p][t]
                link[c] = q if length[q] == length[p] + 1 else self._clone(p, t, q)
            last = c

    def first_documents(self, tokens, n: int) -> list:
        """For each window of n tokens the first document that holds it, None where none does (matching statistics)."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        out = []
        for i, t in enumerate(tokens):
            while state and t not in nxt[state]:
                state = link[state]
                size = length[state]
            state = nxt[state].get(t, 0)
            size = size + 1 if state else 0
            while length[link[state]] >= n if state else False:
                state = link[state]
                size = length[state]
            if i >= n - 1:
                out.append(first[state] if size >= n else None)
        return out


def first_documents(strings: list[tuple], docs: list[int], n: int) -> list[list[int]]:
    """For each string and each of its windows of n tokens, the least document of docs that holds the window."""
    automaton = SuffixAutomaton()
    for i in sorted(range(len(strings)), key=docs.__getitem__):
        automaton.add(strings[i], docs[i])
    return [automaton.first_documents(s, n) for s in strings]


def _keys(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Of (hash, text), rows of two kinds. bucket >= 0: distinct keys of a batch, with the text's hash for each, or null
    where several texts have it; these meet those of other batches. bucket -1: (hash, keys) known to be shared within
    a batch already. So a key of very many documents is one entry for each batch. Copies of a text are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            doc, key = [], []
            for lo, _, raw, offsets in chunks(b.column(1)):
                _, row, _, _, k, _ = segments(raw, offsets, n)
                doc.append(ids[row + lo])
                key.append(k)
            if not doc:
                continue
            doc, key = np.concatenate(doc), np.concatenate(key)
            order = np.lexsort((doc, key))
            doc, key = doc[order], key[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            doc, key = doc[new], key[new]
            head = np.ones(len(key), dtype=bool)
            head[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(head)
            many = np.diff(np.concatenate([starts, [len(key)]])) > 1
            some = np.repeat(many, np.diff(np.concatenate([starts, [len(key)]])))
            # known to be shared: by document
            d, k = doc[some], key[some]
            order = np.argsort(d, kind="stable")
            d, k = d[order], k[order]
            cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
            # one entry for each key to the exchange
            uk, ud = key[starts], doc[starts]
            place = (uk >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(place, kind="stable")
            place, uk, ud, um = place[order], uk[order], ud[order], many[order]
            ends = np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(ends))
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([ends[full], [len(uk)], len(uk) + cuts[1:], [len(uk) + len(d)] if len(cuts) else []]).astype(np.int32)), pa.array(np.concatenate([uk, k]).view(np.int64)))
            owners = pa.ListArray.from_arrays(pa.array(np.concatenate([ends[full], [len(uk)] * (1 + len(cuts))]).astype(np.int32)), pa.array(ud.astype(np.int64), mask=um))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([full, np.full(len(cuts), -1)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(len(full), np.int64), d[cuts]]).astype(np.int64)), keys, owners], names=["bucket", "hash", "keys", "hashes"])

    return docs.mapInArrow(run, "bucket int, hash long, keys array<long>, hashes array<long>")


def _shared(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """(hash, key) of the keys of one bucket that are in two texts or more, but for those that a batch knows."""
    keys = np.concatenate([c.flatten().to_numpy() for c in group.column("keys").chunks])
    owners = pa.concat_arrays([c.flatten() for c in group.column("hashes").chunks])
    several = owners.is_null().to_numpy(zero_copy_only=False)
    docs = owners.fill_null(0).to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, docs, several = keys[order], docs[order], several[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    mixed = np.logical_or.reduceat(several, starts) | (np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts))
    hit = np.repeat(mixed, sizes) & ~several
    yield pa.RecordBatch.from_arrays([pa.array(docs[hit]), pa.array(keys[hit])], names=["hash", "key"])


def _segment_rows(texts: DataFrame, n: int) -> DataFrame:
    """doc, hash, start, windows, seg (16 bytes), key, words of each candidate segment of (doc, hash, text, keys, heavy).

    words is the text of the segment, given once for each distinct segment of a chunk. heavy are further keys, whose
    windows are segments of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            known = []
            for wanted in (b.column(3), b.column(4)):
                flat, ends = wanted.flatten().to_numpy().view(np.uint64), wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
                owner = np.repeat(np.arange(b.num_rows), np.diff(ends))
                known.append(np.unique(mix(flat) ^ mix(owner.astype(np.uint64) + np.uint64(77))))

            def among(at: np.ndarray, some: np.ndarray) -> np.ndarray:
                return some[np.minimum(np.searchsorted(some, at), len(some) - 1)] == at if len(some) else np.zeros(len(at), bool)

            for lo, _, raw, offsets in chunks(b.column(2)):
                h, row, first, count, key, of = segments(raw, offsets, n)
                at = mix(key) ^ mix((row + lo).astype(np.uint64) + np.uint64(77))
                hot = among(at, known[1])
                keep = among(at, known[0]) | hot
                row, first, count, key, hot = row[keep], first[keep], count[keep], key[keep], hot[keep]
                if not len(row):
                    continue
                cut = np.zeros(len(row), dtype=bool)
                if hot.any():
                    times = np.where(hot, count, 1)
                    which = np.repeat(np.arange(len(row)), times)
                    step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                    cut = hot[which]
                    row, first, count, key = row[which], first[which] + step, np.where(cut, 1, count[which]), key[which]
                size = count + n - 1
                begin = np.cumsum(size) - size
                inside = np.arange(int(size.sum())) - np.repeat(begin, size)
                tokens = h[np.repeat(first, size) + inside]
                weight = mix(inside.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
                one, two = (mix(np.add.reduceat(mix(tokens * weight + np.uint64(salt)), begin) + size.astype(np.uint64)) for salt in (0, 0x51ED270B))
                key = np.where(cut, one, key)
                order = np.lexsort((two, one))
                lead = np.zeros(len(order), dtype=bool)
                lead[order[np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])]] = True
                _, start, end = spans(raw, offsets, SPACE)
                whole = raw.tobytes()
                words = [whole[x:y] if shown else None for x, y, shown in zip(start[first].tolist(), end[first + size - 1].tolist(), lead.tolist(), strict=True)]
                seg = np.stack([one, two], axis=1).tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[row + lo].astype(np.int64)), pa.array(texts[row + lo].astype(np.int64)),
                    pa.array((first - np.searchsorted(of, row)).astype(np.int32)), pa.array(count.astype(np.int32)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(one), [None, pa.py_buffer(seg)]).cast(pa.binary()),
                    pa.array(key.view(np.int64)), pa.array(words, pa.binary()),
                ], names=["doc", "hash", "start", "windows", "seg", "key", "words"])

    return texts.mapInArrow(run, "doc long, hash long, start int, windows int, seg binary, key long, words binary")


def _first_docs(n: int):
    """firsts (the first document of each window) of the segments of one shard."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        docs, windows, keys = (group.column(c).to_numpy() for c in ("doc", "windows", "key"))
        # only segments of one key can share windows: those alone with theirs have nothing to meet
        _, of, times = np.unique(keys, return_inverse=True, return_counts=True)
        alone = times[of] == 1
        found: list = [[d] * k if x else None for d, k, x in zip(docs.tolist(), windows.tolist(), alone, strict=True)]
        rest = np.flatnonzero(~alone).tolist()
        words = group.column("words").take(pa.array(rest, pa.int64())).to_pylist()
        strings = [tuple(w.split()) for w in words]
        for i, firsts in zip(rest, first_documents(strings, [int(docs[i]) for i in rest], n), strict=True):
            found[i] = firsts
        yield pa.RecordBatch.from_arrays([group.column("seg").combine_chunks(), pa.array(found, pa.list_(pa.int64()))], names=["seg", "firsts"])

    return run


def covered(docs: DataFrame, n: int = 13) -> DataFrame:
    """Of (doc, text): (doc, hash, starts, copy) for each document that loses words: the first words (from 0) of the
    windows that go, or copy where a document of a smaller id has the same text."""
    spark = docs.sparkSession
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    slim = staged(hashed.select("doc", "hash", F.concat_ws(":", "hash", F.octet_length("text"), F.crc32(F.col("text").cast("binary"))).alias("same")), "texts")
    groups = slim.groupBy("same").agg(F.min("doc").alias("least"), F.count("*").alias("n"), F.first("hash").alias("hash"))
    reps = staged(groups, "reps")
    copies = lookup(slim, reps.filter("n > 1").select("same", "least", "n"), "same", "n").filter("doc > least").select("doc", "hash")

    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = staged(_keys(hashed.select("hash", "text"), n, buckets), "keys")
    met = by_group(entries.filter("bucket >= 0").select("bucket", "keys", "hashes"), "bucket", _shared, "hash long, key long")
    known = entries.filter("bucket < 0").select("hash", F.explode("keys").alias("key"))
    pairs = staged(met.unionByName(known), "pairs")
    release(entries)

    heavy = staged(pairs.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= HEAVY_KEY), "heavy")
    marked = pairs.withColumn("cut", F.lit(False))
    if not heavy.isEmpty():
        marked = pairs.join(heavy, "key", "left_anti").withColumn("cut", F.lit(False)).unionByName(lookup(pairs, heavy, "key", "n").withColumn("cut", F.lit(True)))
    some = lambda c: F.collect_set(F.when(c, F.col("key")))
    wanted = marked.groupBy("hash").agg(some(~F.col("cut")).alias("keys"), some(F.col("cut")).alias("heavy")).join(reps.select("hash", F.col("least").alias("doc")), "hash")
    rows = staged(_segment_rows(hashed.join(wanted, ["doc", "hash"]).select("doc", "hash", "text", "keys", "heavy"), n), "segments")
    release(pairs, heavy)

    distinct = staged(rows.groupBy("seg").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"), F.count("*").alias("n"), F.first("windows").alias("windows"), F.first("key").alias("key"), F.first("words", ignorenulls=True).alias("words")), "distinct")
    shards = max(1, -(-distinct.count() // SHARD))
    dealt = distinct.select("seg", "doc", "last", "n", "windows", "key", "words", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
    release()
    firsts = by_group(dealt.select("seg", "doc", "windows", "key", "words", "shard"), "shard", _first_docs(n), "seg binary, firsts array<long>")
    # of no use where every window starts first in the segment's only or last document
    firsts = firsts.join(distinct.select("seg", "n", "last"), "seg").filter(F.array_min("firsts") < F.col("last")).drop("last")
    firsts = staged(firsts, "firsts")
    release(distinct)

    at = lookup(rows.select("doc", "hash", "start", "seg"), firsts, "seg", "n")
    gone = F.filter(F.transform("firsts", lambda first, i: F.when(first < F.col("doc"), F.col("start") + i)), lambda i: i.isNotNull())
    hits = at.select("doc", "hash", gone.alias("at")).filter(F.size("at") > 0)
    starts = staged(hits.groupBy("doc", "hash").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("starts")), "starts")
    release(rows, firsts)
    return starts.withColumn("copy", F.lit(False)).unionByName(copies.distinct().withColumns({"starts": F.lit(None).cast("array<int>"), "copy": F.lit(True)}))


def remove(docs: DataFrame, n: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space; null for null).

    Words are what is between white space, unchanged; a word goes if a window of n consecutive words around it also
    starts in a document with a smaller doc_id, as the input has it. Rows of the same doc_id keep what only they
    share; null doc_ids are compared with nothing. Null and empty texts have no words; texts under n words stay.
    doc_id is of any type that has an order; those that aren't whole numbers are numbered in it first. Other columns
    are not read, whatever their names.
    """
    kind = dict(docs.dtypes)[doc_id]
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        base = base.withColumn("id", F.col("doc_id").cast("long"))
    else:
        ids = staged(base.select("doc_id").filter("doc_id is not null").distinct().withColumn("one", F.lit(1).cast("long")), "ids")
        base = staged(base.join(running_sums(ids, ["doc_id"], "one").select("doc_id", F.col("row").alias("id")), "doc_id", "left"), "numbered")
    slim = base.select(F.col("id").alias("doc"), "text").filter("doc is not null and text is not null")
    same = (F.col("id") == F.col("doc")) & (F.xxhash64("text") == F.col("hash"))
    marked = base.join(covered(slim, n), same, "left").select("doc_id", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, removed, kept = [], [], []
            for t, starts, copy in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                raw = t.as_py()
                words = raw.encode().split() if raw is not None else []
                count.append(len(words))
                if copy and len(words) >= n:
                    words = []
                elif starts.is_valid:
                    deep = np.zeros(len(words) + 1, dtype=np.int32)
                    s = np.unique(starts.values.to_numpy())
                    deep[s] += 1
                    deep[s + n] -= 1
                    stays = np.cumsum(deep[:-1]) == 0
                    words = [w for w, k in zip(words, stays, strict=True) if k]
                removed.append(count[-1] - len(words))
                kept.append(b" ".join(words).decode() if raw is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return marked.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
     p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
     f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM p JOIN f USING (s) WHERE first < doc_id),
     words AS (SELECT doc_id, w[k] AS word, k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM d)),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def brute_force(docs: list[tuple[int | None, str | None]], n: int = 13) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) of each row, by a table of all windows."""
    words = [(t or "").encode().split() for _, t in docs]
    first: dict = {}
    for (d, _), w in zip(docs, words, strict=True):
        if d is not None:
            for i in range(len(w) - n + 1):
                x = tuple(w[i : i + n])
                first[x] = min(d, first.get(x, d))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = set()
        if d is not None:
            for i in range(len(w) - n + 1):
                if first[tuple(w[i : i + n])] < d:
                    gone.update(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
