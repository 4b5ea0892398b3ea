"""Exact BM25 top-k: an inverted index for each shard of documents, searched by block-max WAND.

Bounds are kept at four depths: the largest impact of a term in the shard, in a span of neighbouring blocks, in a
block, and the impacts themselves. WAND moves its cursors to the next pivot, the first place where the bounds of the
query's terms add up to the k-th best score known; block-max WAND then looks at the bounds of that place's block
before it reads a posting. Here the pivots of all cursors are found at once, as arrays: a shard whose bounds stay
below the threshold is left out; of the others spans are taken by falling bound, and all behind the first that is
below are skipped, for every term; in a span only blocks whose own bounds reach the threshold are pivots, and only
their postings are read. Each step's scores raise the threshold for the next one. All of that is done for some dozens of
queries at once, each with its own threshold.

Blocks are only worth skipping if documents in them are alike. So a shard's documents are in the order of their most
frequent word (of the shard's words), then of a MinHash of their rarer ones: texts of one language, and near copies, are neighbours.

Document frequencies, the number of documents and their mean length are those of all shards, so scores do not
depend on how documents are dealt out, and the merged best k are exact. Queries go in blocks of bounded size, each of
which is one pass over the index: first over a share of the shards, whose k-th best scores are where the thresholds
of the others start.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaar.llm.common import by_group, release, staged
from bazaar.llm.words import NOT_ALNUM, chunks, hashes, mix, spans

K1, B = 1.2, 0.75
#: A shard is closed at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 8_192, 1_500_000
#: Documents of a block; blocks of a span.
BLOCK, SPAN = 16, 8
#: A word in one of so many documents of a shard, or more, is a row of a matrix, the most frequent first, up to so many numbers.
DENSE, NUMBERS = 32, 1 << 23
#: So many queries are searched together, or fewer with so many postings between them; one query is never cut.
TOGETHER, POSTINGS = 64, 1 << 20
#: Terms of a block of queries, about; one query is never cut.
QUERY_TERMS = 2_000_000
#: One in so many shards is searched first, for thresholds.
SEED = 8
#: Scores are compared and given to so many decimals, so that equal ones tie however they were added up.
DECIMALS = 6
_MARGIN = 10.0**-DECIMALS


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of each i, count[i] of them, one after the other."""
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


def _terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of the distinct words of each text, by row and term; number of words of each row."""
    rows, terms, times, sizes = [], [], [], []
    for lo, hi, raw, offsets in chunks(text):
        row, start, end = spans(raw, offsets, NOT_ALNUM)
        h = hashes(raw, start, end)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
        rows.append(row[first] + lo)
        terms.append(h[first])
        times.append(np.diff(np.concatenate([first, [len(h)]])))
        sizes.append(np.bincount(row, minlength=hi - lo))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in (rows, terms, times, sizes))


def _like(doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """The n documents of a shard so that like ones are neighbours; doc is sorted, each of its terms stands once."""
    common, rare = np.full(n, len(term)), np.full(n, np.iinfo(np.uint64).max, np.uint64)
    if len(term):
        names, of, df = np.unique(term, return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((names, -df))] = np.arange(len(names))
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        common[doc[first]] = np.minimum.reduceat(rank[of], first)
        some = (df > 1) & (16 * df < n)
        rare[doc[first]] = np.minimum.reduceat(np.where(some[of], mix(term), np.uint64(np.iinfo(np.uint64).max)), first)
    return np.lexsort((rare, common))


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each shard: ids and sizes of its documents, terms, ends of their postings, posting documents and times.

    Words are lower-cased; a null text has none. Other columns are not read, whatever their names.
    """
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held, n = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            doc, term, times, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            like = _like(doc, term, n)
            size, place = size[like], np.empty(n, np.int32)
            place[like] = np.arange(n)
            doc = place[doc]
            order = np.lexsort((doc, term))
            doc, term, times = doc[order], term[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
            one = lambda x, t: pa.array([x], pa.list_(t))
            columns = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(ids).take(pa.array(like))), one(size.astype(np.int32), pa.int32()), one(term[first].view(np.int64), pa.int64()), one(np.concatenate([first[1:], [len(term)]]).astype(np.int32) if len(first) else np.zeros(0, np.int32), pa.int32()), one(doc.astype(np.int32), pa.int32()), one(times.astype(np.int32), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "terms", "ends", "docs", "times"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                row, term, times, size = _terms(part.column(1))
                parts.append(((row + n).astype(np.int32), term, times.astype(np.int32), size))
                ids.append(part.column(0))
                n, held = n + part.num_rows, held + len(term)
                if n >= SHARD_DOCS or held >= SHARD_POSTINGS:
                    yield shard()
                    ids, parts, held, n = [], [], 0, 0
        if n:
            yield shard()

    return docs.select(F.col(doc_id), F.lower(F.col(text))).mapInArrow(run, f"ids array<{kind}>, sizes array<int>, terms array<long>, ends array<int>, docs array<int>, times array<int>")


def _frequencies(shards: DataFrame, queries: DataFrame, buckets: int) -> DataFrame:
    """(query, term, times, df) of the distinct words of queries (query, text), df over all shards.

    Terms go to buckets as packed arrays: those of a shard with their numbers of documents, those of a batch of
    queries with the query and its times.
    """

    def pack(term: np.ndarray, n: np.ndarray, query: np.ndarray | None) -> pa.RecordBatch:
        place = (term >> np.uint64(24)) % np.uint64(buckets)
        order = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[order], np.arange(buckets + 1, dtype=np.uint64)).astype(np.int32)
        full = np.flatnonzero(np.diff(ends))
        at = pa.array(np.concatenate([ends[full], [len(term)]]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x[order].astype(np.int64))) for x in (term.view(np.int64), n)]
        owner = pa.ListArray.from_arrays(at, pa.array(query[order])) if query is not None else pa.nulls(len(full), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *lists, owner], names=["bucket", "terms", "n", "queries"])

    def from_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, ends in zip(b.column(0), b.column(1), strict=True):
                yield pack(terms.values.to_numpy().view(np.uint64), np.diff(ends.values.to_numpy(), prepend=0), None)

    def from_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term, times, _ = _terms(b.column(1))
            yield pack(term, times, b.column(0).to_numpy()[row])

    def meet(group: pa.Table) -> Iterator[pa.RecordBatch]:
        asked = group.filter(group.column("queries").is_valid())
        if not asked.num_rows:
            return
        flat = lambda t, c: np.concatenate([x.flatten().to_numpy() for x in t.column(c).chunks])
        term, times, query = (flat(asked, c) for c in ("terms", "n", "queries"))
        known, at = np.unique(term, return_inverse=True)
        df = np.zeros(len(known), dtype=np.int64)
        held = group.filter(group.column("queries").is_null())
        if held.num_rows:
            own, n = flat(held, "terms"), flat(held, "n")
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[place] == own
            df += np.bincount(place[hit], weights=n[hit], minlength=len(known)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(term), pa.array(times), pa.array(df[at])], names=["query", "term", "times", "df"])

    schema = "bucket int, terms array<long>, n array<long>, queries array<long>"
    rows = shards.select("terms", "ends").mapInArrow(from_shards, schema).unionByName(queries.select("query", F.lower("text").alias("text")).mapInArrow(from_queries, schema))
    return by_group(rows, "bucket", meet, "query long, term long, times long, df long")


class Shard:
    """A shard's postings of the terms in ``wanted`` (sorted), with their impacts, and the maxima of these by block, span and term.

    Terms of many documents have no lists but a matrix of impacts: what they add to a document's score is known before its
    block is read, so bounds are only needed of the others. It is multiplied in single precision, the error of which is
    part of every comparison; the few documents that may be among the best are scored once more in double precision.
    """

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, ends: np.ndarray, docs: np.ndarray, times: np.ndarray, mean: float, wanted: np.ndarray):
        place = np.minimum(np.searchsorted(wanted, terms), max(0, len(wanted) - 1))
        keep = wanted[place] == terms if len(wanted) else np.zeros(len(terms), bool)
        length = np.diff(ends, prepend=0)
        own = np.repeat(keep, length)
        self.n = len(sizes)
        self.blocks = -(-self.n // BLOCK)
        self.spans = -(-self.blocks // SPAN)
        docs, tf = docs[own], times[own].astype(np.float64)
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[docs] / max(mean, 1e-9)))
        place, length = place[keep], length[keep]
        dense = length * DENSE >= self.n
        most_rows = NUMBERS // max(self.n, 1)
        if dense.sum() > most_rows:
            dense[np.argsort(np.where(dense, -length, 1), kind="stable")[most_rows:]] = False
        self.row = np.full(len(wanted), -1)  # of each term: its row of the matrix
        self.row[place[dense]] = np.arange(int(dense.sum()))
        self.matrix = np.zeros((int(dense.sum()), self.n))
        self.term_most = np.zeros(len(wanted))
        many = np.repeat(dense, length)
        self.matrix[np.repeat(self.row[place[dense]], length[dense]), docs[many]] = impact[many]
        if dense.any():
            self.term_most[place[dense]] = self.matrix.max(axis=1)
        self.rough = self.matrix.astype(np.float32)
        self.listed = np.zeros(len(wanted), np.int64)  # of each term: its postings in lists
        self.listed[place[~dense]] = length[~dense]
        self.docs, self.impact = docs[~many], impact[~many]
        self.inside = self.docs % BLOCK
        term, block = np.repeat(place[~dense], length[~dense]), self.docs // BLOCK

        def cut(*by: np.ndarray) -> np.ndarray:
            new = np.ones(len(by[0]), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in by])
            return np.flatnonzero(new)

        most = lambda x, at: np.maximum.reduceat(x, at) if len(at) else np.zeros(0)
        at = cut(term, block)  # of each (term, block): its first posting
        term, self.block, self.most, self.posting = term[at], block[at], most(self.impact, at), np.append(at, len(term))
        at = cut(term, self.block // SPAN)  # of each (term, span): its first (term, block)
        term, self.span, self.span_most, self.group = term[at], self.block[at] // SPAN, most(self.most, at), np.append(at, len(term))
        self.of = np.searchsorted(term, np.arange(len(wanted) + 1))  # of each term: its first (term, span)
        at = cut(term)
        self.term_most[term[at]] = most(self.span_most, at)

    def search(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """Of the queries terms[ends[q]:ends[q + 1]] (places in wanted) that may find ``least[q]`` or more here: q, documents
        that may belong to its best k, their scores, and how many blocks' postings were read."""
        query = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        bound = np.bincount(query, weights=self.term_most[terms] * weights, minlength=len(ends) - 1)
        asked = np.flatnonzero((bound > 0) & (bound >= least - _MARGIN))
        before = np.cumsum(np.bincount(query, weights=self.listed[terms], minlength=len(ends) - 1)[asked])
        lo = 0
        while lo < len(asked):
            hi = int(np.searchsorted(before, (before[lo - 1] if lo else 0) + POSTINGS, "right"))
            hi = max(lo + 1, min(hi, lo + TOGETHER))
            yield from self._together(asked[lo:hi], ends, terms, weights, k, least)
            lo = hi

    def _together(self, some: np.ndarray, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        m, count = len(some), ends[some + 1] - ends[some]
        own, q = _spread(ends[some], count), np.repeat(np.arange(m), count)
        t, w = terms[own], weights[own]
        dense = self.row[t] >= 0
        dq, dw, row = q[dense], w[dense], self.row[t[dense]]
        used, at = np.unique(row, return_inverse=True)
        by = np.zeros((m, len(used)), np.float32)
        by[dq, at] = dw
        base = by @ self.rough[used]
        # what single precision can be wrong by: each weight, impact and product is rounded, and each sum
        rows = np.bincount(dq, minlength=m)
        slack = _MARGIN + np.finfo(np.float32).eps * (rows + 3) * np.bincount(dq, weights=dw * self.term_most[t[dense]], minlength=m)
        floor = least[some] - slack
        t, w, q = t[~dense], w[~dense], q[~dense]
        count = self.of[t + 1] - self.of[t]
        g, w, q = _spread(self.of[t], count), np.repeat(w, count), np.repeat(q, count)  # cursors: (query, term, span)
        place = q * self.spans + self.span[g]
        base_block = np.maximum.reduceat(base, np.arange(0, self.n, BLOCK), axis=1)
        bound = np.maximum.reduceat(base_block, np.arange(0, self.blocks, SPAN), axis=1) + np.bincount(place, weights=self.span_most[g] * w, minlength=m * self.spans).reshape(m, -1)
        pivots = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)  # of each span: which one it is by falling bound
        found, docs, rough, listed, read = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(m, np.int64)
        lo, step = 0, 2
        while lo < self.spans:
            chosen = (pivots >= lo) & (pivots < lo + step) & (bound >= floor[:, None]) & (bound > 0)
            lo, step = lo + step, 2 * step
            if not chosen.any():
                break  # nor do those behind reach it
            own = np.flatnonzero(chosen.ravel()[place])
            first = self.group[g[own]]
            count = self.group[g[own] + 1] - first
            b, bw, bq = _spread(first, count), np.repeat(w[own], count), np.repeat(q[own], count)  # (query, term, block) in these spans
            block = bq * self.blocks + self.block[b]
            inner = base_block + np.bincount(block, weights=self.most[b] * bw, minlength=m * self.blocks).reshape(m, -1)
            live = (inner >= floor[:, None]) & (inner > 0) & np.repeat(chosen, SPAN, axis=1)[:, : self.blocks]
            read += live.sum(axis=1)
            pairs = np.flatnonzero(live)  # (query, block) that are read
            which = np.full(m * self.blocks, -1)
            which[pairs] = np.arange(len(pairs))
            own = np.flatnonzero(which[block] >= 0)
            first = self.posting[b[own]]
            count = self.posting[b[own] + 1] - first
            p = _spread(first, count)
            more = np.bincount(np.repeat(which[block[own]], count) * BLOCK + self.inside[p], weights=self.impact[p] * np.repeat(bw[own], count), minlength=len(pairs) * BLOCK)
            of = np.repeat(pairs // self.blocks, BLOCK)
            doc = ((pairs % self.blocks)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            real = np.minimum(doc, self.n - 1)
            total = more + base[of, real]
            hit = (doc < self.n) & (total > 0) & (total >= floor[of])
            found, docs, rough, listed = (np.concatenate(x) for x in ((found, of[hit]), (docs, doc[hit]), (rough, total[hit]), (listed, more[hit])))
            order = np.lexsort((-rough, found))
            found, docs, rough, listed = found[order], docs[order], rough[order], listed[order]
            start = np.searchsorted(found, np.arange(m + 1))
            full = np.flatnonzero(np.diff(start) >= k)
            floor[full] = np.maximum(floor[full], rough[start[full] + k - 1] - 2 * slack[full])
            keep = rough >= floor[found]
            found, docs, rough, listed = found[keep], docs[keep], rough[keep], listed[keep]
        start = np.cumsum(rows) - rows
        count = rows[found]
        own = _spread(start[found], count)
        exact = np.bincount(np.repeat(np.arange(len(found)), count), weights=dw[own] * self.matrix[row[own], np.repeat(docs, count)], minlength=len(found))
        scores = np.round(listed + exact, DECIMALS)
        start = np.searchsorted(found, np.arange(m + 1))
        for i, j in enumerate(some.tolist()):
            mine = slice(start[i], start[i + 1])
            yield j, docs[mine], scores[mine], int(read[i])


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", query_id: str = "doc_id", query_text: str = "text") -> DataFrame:
    """query_id, doc_id, rank (from 1), score: the k best documents of each query by BM25, by falling score, then doc_id.

    A query's score of a document is the sum over the query's words, each as often as it stands there, with
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Only documents that share a word with the query are ranked, fewer
    than k where there are no more. Queries without words, and null ones, have no rows; repeated queries count once,
    repeated documents each. A null doc_id is ranked after all others of its score. Other columns of either table are
    not read, whatever their names.
    """
    spark = docs.sparkSession
    shards = staged(index(docs, doc_id, text).withColumn("seed", (F.pmod(F.xxhash64("sizes"), F.lit(SEED)) == 0)), "shards", 1)
    n, words = shards.agg(F.sum(F.size("ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    if not n:
        n, words = 0, 0
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("text")).filter("text is not null").dropDuplicates()
    asked = staged(asked.withColumn("query", F.xxhash64("query_id", "text")), "queries")
    terms = staged(_frequencies(shards, asked, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "frequencies")
    packed = staged(terms.filter("df > 0").groupBy("query").agg(F.collect_list(F.struct("term", "times", "df")).alias("terms")), "packed")
    release(terms)
    blocks = max(1, math.ceil((packed.agg(F.sum(F.size("terms"))).first()[0] or 0) / QUERY_TERMS))
    every = None
    for i in range(blocks):
        block = packed.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        for more in _pass(shards, block, k, n, words / max(n, 1), dict(docs.dtypes)[doc_id]):
            every = more if every is None else every.unionByName(more)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = every.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.join(asked.select("query", "query_id"), "query").select("query_id", "doc_id", "rank", "score")


def _pass(shards: DataFrame, block: DataFrame, k: int, n: int, mean: float, kind: str) -> list[DataFrame]:
    """What a block of queries finds in the seed shards, then in the others. The block's terms, and a threshold of each
    of its queries, go through the driver."""
    rows = block.toArrow()
    lists = rows.column("terms").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    flat = lists.flatten()
    term, times, df = (flat.field(i).to_numpy() for i in range(3))
    wanted, place = np.unique(term.view(np.uint64), return_inverse=True)
    weight = times * np.log1p((n - df + 0.5) / (df + 0.5))
    # queries with the same most frequent word, mostly of one language, are searched together: they need the same rows of matrices
    size = np.diff(ends)
    order = np.argsort(np.maximum.reduceat(df, ends[:-1]), kind="stable") if len(size) else np.zeros(0, np.int64)
    own = _spread(ends[order], size[order])
    names, ends, place, weight = rows.column("query").to_numpy()[order], np.concatenate([[0], np.cumsum(size[order])]), place[own], weight[own]
    sc = shards.sparkSession.sparkContext
    shared = sc.broadcast((names, ends, place.astype(np.int32), weight, wanted))

    def run(least: Broadcast):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query, ends, place, weight, wanted = shared.value
            floor = least.value.copy()  # rises where this task knows k of its own
            best: dict[int, tuple[pa.Array, np.ndarray]] = {}
            for b in batches:
                for j in range(b.num_rows):
                    ids = b.column(0)[j].values
                    sizes, terms, stops, docs, times = (b.column(c)[j].values.to_numpy() for c in range(1, 6))
                    shard = Shard(sizes, terms.view(np.uint64), stops.astype(np.int64), docs, times, mean, wanted)
                    for q, hit, got, _ in shard.search(ends, place, weight, k, floor):
                        if not len(hit):
                            continue
                        names = ids.take(pa.array(hit))
                        if q in best:
                            names, got = pa.concat_arrays([best[q][0], names]), np.concatenate([best[q][1], got])
                        v = names.to_pylist()
                        order = np.array(sorted(range(len(v)), key=lambda i: (-got[i], v[i] is None, v[i] if v[i] is not None else 0))[:k])
                        best[q] = names.take(pa.array(order)), got[order]
                        if len(order) == k:
                            floor[q] = max(floor[q], got[order[-1]])
            found = sorted(best)
            for lo in range(0, len(found), 1024):
                some = found[lo : lo + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query[some], [len(best[q][1]) for q in some])), pa.concat_arrays([best[q][0] for q in some]), pa.array(np.concatenate([best[q][1] for q in some]))], names=["query", "doc_id", "score"])

        return find

    schema = f"query long, doc_id {kind}, score double"
    least = np.zeros(len(names))
    seeds = staged(shards.filter("seed").drop("seed").mapInArrow(run(sc.broadcast(least)), schema), "seeds")
    kth = seeds.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("rank") == k)
    at = {q: i for i, q in enumerate(names.tolist())}
    for r in kth.select("query", "score").collect():
        least[at[r["query"]]] = r["score"]
    return [seeds, staged(shards.filter("not seed").drop("seed").mapInArrow(run(sc.broadcast(least)), schema), "found")]


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, docs.filter("doc_id % 100 = 0"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
     tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY doc_id, t),
     size AS (SELECT doc_id, 0.25::DOUBLE + 0.75::DOUBLE * len(w) / (SELECT avg(len(w)) FROM d) AS size FROM d),
     idf AS (SELECT t, ln(1 + ((SELECT count(*) FROM d) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY t),
     s AS (SELECT q.doc_id AS query_id, x.doc_id, round(sum(q.tf * idf * x.tf * 2.2::DOUBLE / (x.tf + 1.2::DOUBLE * size)), 6) AS score
           FROM tf q JOIN idf USING (t) JOIN tf x USING (t) JOIN size ON size.doc_id = x.doc_id WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, x.doc_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id, rank, score FROM r WHERE rank <= 10
"""


def brute_force(docs: list[tuple[object, str | None]], queries: list[tuple[object, str | None]], k: int = 10) -> set[tuple]:
    """(query_id, doc_id, rank, score) by scoring every document."""
    import re

    bags = [Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for _, t in docs]
    df = Counter(w for b in bags for w in b)
    mean = sum(sum(b.values()) for b in bags) / max(1, len(bags))
    out = set()
    for qid, t in set(queries):
        q = Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))
        scored = []
        for (d, _), b in zip(docs, bags, strict=True):
            size = sum(b.values())
            s = sum(m * math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * (K1 + 1) / (b[w] + K1 * (1 - B + B * size / mean)) for w, m in q.items() if w in b)
            if s > 0:
                scored.append((-round(s, DECIMALS), d is None, d or 0, d))
        out |= {(qid, x[3], i, -x[0]) for i, x in enumerate(sorted(scored)[:k], 1)}
    return out
