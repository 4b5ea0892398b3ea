"""Self-join of documents by the Jaccard similarity of their word n-grams: MinHash banding, then exact checks.

Work is dealt out so that no group's pairs are ever rows. Documents with equal n-gram sets are one set.
Sets that agree with their bucket's leader in two bands or more form clusters, which are only a way to deal out
work. All pairs of a unit of work are checked, by matrix products over two blocks of bounded size. There are three
kinds of units, and each pair of sets that agree in a band is counted in just one:
  - blocks of a cluster, two by two;
  - where a bucket holds sets of several clusters, its largest cluster is the host, the others are guests: blocks of
    that whole cluster with blocks of its guests;
  - blocks of a bucket's guests, two by two, for pairs of which neither is in a cluster that hosts the other anywhere;
    pairs that agree in several bands count in the first.
A set has a bucket, and so a host, for each band at most, so rows are in proportion to sets while clusters and buckets
are within a block; in larger ones, of N sets, each set goes to N / BLOCK_SETS units, as links within N sets may be N * N.
All give each set its number of links and a spanning forest of the links, whose components are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import by_group, components, free, lookup, staged
from bazaar.llm.words import NOT_ALNUM, chunks, grams, hashes, mix, spans

#: Shingles of a block of a cluster; a task holds two blocks.
BLOCK_SHINGLES = 3_000_000
#: Sets of a block, at most about.
BLOCK_SETS = 256


def bands_and_rows(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands b and rows r of a band: the largest r for which b * r <= most hashes find a pair at the threshold
    with probability ``recall`` or more, 1 - (1 - threshold ** r) ** b. More rows mean fewer false candidates."""
    best = None
    for r in range(1, 17):
        b = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))) if threshold < 1 else 1
        if b * r <= most:
            best = (b, r)
    if best is None:
        raise ValueError(f"recall {recall} at {threshold} takes more than {most} hashes")
    return best


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each row, sorted; a text of fewer words, but not none, has one."""
    row, start, end = spans(raw, offsets, NOT_ALNUM)
    h = hashes(raw, start, end)
    at, g = grams(h, row, n)
    rows = [row[at]]
    got = [g]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            first = np.searchsorted(row, short)
            acc = np.full(len(short), k, dtype=np.uint64)
            for j in range(k):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[first + j])
            rows.append(short)
            got.append(acc)
    row, g = np.concatenate(rows), np.concatenate(got)
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return row[new], g[new]


def _lists(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1)).astype(np.int32)


def set_keys(g: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """16 bytes that identify each set; None for an empty one."""
    c1, c2 = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mix(g ^ np.uint64(0x243F6A8885A308D3)), mix(g ^ np.uint64(0x13198A2E03707344))))
    a, b = mix(c1[ends[1:]] - c1[ends[:-1]]), mix((c2[ends[1:]] - c2[ends[:-1]]) + np.diff(ends).astype(np.uint64))
    raw = np.stack([a, b], axis=1).astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if ends[i + 1] > ends[i] else None for i in range(len(ends) - 1)]


def signatures(g: np.ndarray, ends: np.ndarray, b: int, r: int) -> np.ndarray:
    """Band hashes (sets, b) of MinHash signatures of b * r hashes; empty sets must be left out."""
    rng = np.random.default_rng(20240501)
    factors = rng.integers(0, 1 << 63, size=b * r, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(ends) - 1, b), dtype=np.uint64)
    starts = ends[:-1].astype(np.int64)
    for band in range(b):
        acc = np.full(len(starts), band + 1, dtype=np.uint64)
        for k in range(r):
            low = np.minimum.reduceat(g * factors[band * r + k], starts)
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = acc
    return out


def _sketch(docs: DataFrame, n: int, b: int, r: int) -> DataFrame:
    """doc_id, text_hash, key (16 bytes, null where there is no word), n, bands of each (doc_id, text, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column(1)):
                row, g = shingles(raw, offsets, n)
                ends = _lists(row, hi - lo)
                full = np.diff(ends) > 0
                bands = np.zeros((hi - lo, b), dtype=np.uint64)
                if full.any():
                    bands[full] = signatures(g, np.concatenate([ends[:-1][full], ends[-1:]]), b, r)
                at = pa.array(np.concatenate([[0], np.cumsum(full * b)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(set_keys(g, ends), pa.binary()), pa.array(np.diff(ends)), pa.ListArray.from_arrays(at, pa.array(bands[full].reshape(-1).view(np.int64)))], names=["doc_id", "text_hash", "key", "n", "bands"])

    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, text_hash long, key binary, n int, bands array<long>")


def _full_sets(docs: DataFrame, n: int) -> DataFrame:
    """key and shingles of each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column(0)):
                row, g = shingles(raw, offsets, n)
                ends = _lists(row, hi - lo)
                out = pa.RecordBatch.from_arrays([pa.array(set_keys(g, ends), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(g.view(np.int64)))], names=["key", "shingles"])
                yield out.filter(out.column(0).is_valid())

    return docs.mapInArrow(run, "key binary, shingles array<long>")


def overlaps(lists: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, counts) of the sizes of all intersections, in tiles of the upper triangle.

    The diagonal means nothing. Shingles of one list only can't be shared. The others become columns of 0/1 matrices, taken in slices.
    """
    m = len(lists)
    flat = np.concatenate(lists)
    of = np.repeat(np.arange(m), [len(x) for x in lists])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    names, column = np.unique(column[keep], return_inverse=True)
    of = of[keep]
    tile, width = 1024, 4096
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    for i in range(0, m, tile):
        for j in range(i, m, tile):
            rows, cols = min(tile, m - i), min(tile, m - j)
            total = np.zeros((rows, cols), dtype=np.float32)
            left, right = (of >= i) & (of < i + rows), (of >= j) & (of < j + cols)
            a, b = (column[left], of[left] - i), (column[right], of[right] - j)
            both = np.intersect1d(a[0], b[0])
            if len(both):
                for lo in range(0, len(both), width):
                    some = both[lo : lo + width]
                    dense = []
                    for (c, o), n in ((a, rows), (b, cols)):
                        s, e = np.searchsorted(c, [some[0], some[-1] + 1])
                        at = np.minimum(np.searchsorted(some, c[s:e]), len(some) - 1)
                        ok = some[at] == c[s:e]
                        x = np.zeros((n, len(some)), dtype=np.float32)
                        x[o[s:e][ok], at[ok]] = 1
                        dense.append(x)
                    total += dense[0] @ dense[1].T
            yield i, j, total


def check_pairs(lists: list[np.ndarray], copies: np.ndarray, half: np.ndarray, threshold: float, counts: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each list, weighted by copies; edges of a spanning forest of them).

    half: 0 if all pairs count, else 1 or 2, and only pairs of a 1 and a 2 count; of these, if ``counts`` is given, those
    for which it is true (of arrays of left and right places).
    """
    m = len(lists)
    size = np.array([len(x) for x in lists], dtype=np.float64)
    across = half.max() > 0
    links, root, edges = np.zeros(m, dtype=np.int64), np.arange(m), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j, shared in overlaps(lists):
        r, c = np.arange(i, i + shared.shape[0]), np.arange(j, j + shared.shape[1])
        # in whole numbers as doubles: the same comparison as shared / union >= threshold
        close = shared / (size[r][:, None] + size[c][None, :] - shared) >= threshold
        if i == j:
            close &= r[:, None] < c[None, :]
        if across:
            close &= half[r][:, None] != half[c][None, :]
        if counts is not None:
            x, y = np.nonzero(close)
            close[x, y] = counts(r[x], c[y])
        links[r] += (close * copies[c][None, :]).sum(axis=1)
        links[c] += (close * copies[r][:, None]).sum(axis=0)
        for x in np.flatnonzero(close.any(axis=1)):
            hit = c[close[x]]
            roots = np.unique(root[hit])
            for k in roots:
                a, b = find(int(r[x])), find(int(k))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((a, b))
            root[hit] = find(int(r[x]))
    return links, edges


def links(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, class_id, copy_of, n_links, text_hash (xxhash64 of the text), key and class_key (of
    its set, null without words, and the least one of its class).

    Two documents are linked if the Jaccard similarity of their sets of n-grams of lower-cased words is at least
    the threshold. n_links counts a document's links, those to documents of an equal set among them; copy_of is
    the least doc_id of that set, class_id that of the component of links. A text of fewer than n words has one
    n-gram of all of them; a text without words, or null, has no links and is a class of its own. Repeated rows
    count as copies of each other. Documents without a doc_id are linked as all others; where all of a set or class are
    without, so are copy_of and class_id. Other columns are not read, whatever their names. Pairs of similarity at the threshold are found with probability ``recall``
    at least, more similar ones with more; nothing else loses a link.
    """
    b, r = bands_and_rows(threshold, recall)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"), F.xxhash64(text).alias("text_hash"))
    sketch = staged(_sketch(base, n, b, r), "sketch")
    sets = staged(sketch.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")

    # buckets of two sets or more, with their leaders
    member = sets.select("key", "n", F.explode("bands").alias("bucket"))
    buckets = staged(member.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("leader")).filter("size > 1"), "buckets")
    inside = staged(lookup(member, buckets, "bucket", "size"), "members")
    stars = inside.filter("key <> leader").groupBy("leader", "key").agg(F.count("*").alias("agree")).filter("agree > 1")
    roots = components(stars.select(F.col("leader").alias("a"), F.col("key").alias("b")))
    own = staged(roots.withColumnRenamed("node", "key").join(sets.select("key", "n"), "key"), "own")
    size = staged(own.groupBy("root").agg(F.sum("n").alias("shingles"), F.count("*").alias("rows")), "size")
    clusters = staged(lookup(own, size.withColumn("weight", F.col("rows")), "root", "weight"), "clusters")

    # buckets that hold several clusters
    placed = inside.select("bucket", "key", "n").join(clusters.select("key", "root", "rows", "shingles"), "key", "left")
    placed = staged(placed.select("bucket", "key", "n", F.coalesce("rows", F.lit(1)).alias("rows"), F.coalesce("root", "key").alias("root"), F.coalesce("shingles", F.col("n").cast("long")).alias("shingles")), "placed")
    host = F.max(F.struct("rows", "root", "shingles")).alias("host")
    meet = staged(placed.groupBy("bucket").agg(host, F.count("*").alias("weight"), (F.min("root") < F.max("root")).alias("several")).filter("several").drop("several"), "meet")
    visitors = staged(lookup(placed.select("bucket", "key", "n", "root"), meet, "bucket", "weight").filter("root <> host.root"), "visitors")
    guests = staged(visitors.select("key", F.col("host.root").alias("root"), F.col("host.rows").alias("rows"), F.col("host.shingles").alias("shingles")).distinct(), "guests")
    of_blocks = lambda shingles, rows: F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(rows / BLOCK_SETS)).cast("int")
    mutual = visitors.groupBy("bucket").agg(F.count("*").alias("weight"), of_blocks(F.sum("n"), F.count("*")).alias("blocks"), (F.min("root") < F.max("root")).alias("several")).filter("several").drop("several")
    mutual = lookup(visitors.select("bucket", "key", "root"), staged(mutual, "mutual"), "bucket", "weight")

    # units of work
    def two_by_two(dealt: DataFrame, *name: str) -> DataFrame:
        """Rows of (key, *name, blocks) once for each other block: unit and half."""
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        return paired.withColumns({"unit": F.xxhash64(*name, low, high), "half": F.when(low == high, F.lit(0)).otherwise((F.col("block") == high).cast("int") + 1)}).drop("blocks", "block", "other")

    blocks = of_blocks(F.col("shingles"), F.col("rows"))
    in_cluster = two_by_two(clusters.select("key", "root", blocks.alias("blocks")), "root")
    among_guests = two_by_two(mutual, "bucket")
    parties = staged(guests.join(sets.select("key", "n"), "key").groupBy("root").agg(F.count("*").alias("guests"), F.first("rows").alias("rows"), of_blocks(F.sum("n"), F.count("*")).alias("parts")), "parties")
    hosts = lookup(clusters, parties.select("root", F.col("rows").alias("weight"), "parts"), "root", "weight").select("key", "root", blocks.alias("blocks"), "parts")
    alone = parties.filter("rows = 1").select(F.col("root").alias("key"), "root", F.lit(1).alias("blocks"), "parts")
    hosts = hosts.unionByName(alone).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visits = lookup(guests.select("key", "root", blocks.alias("blocks")), parties.select("root", F.col("guests").alias("weight"), "parts"), "root", "weight")
    visits = visits.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    across = [x.select("key", F.xxhash64("root", "block", "part", F.lit("guests")).alias("unit"), F.lit(half).alias("half")) for half, x in enumerate((hosts, visits), 1)]
    # what decides where a pair of guests counts: their clusters, those that host them, their bands
    seen = guests.groupBy("key").agg(F.collect_set("root").alias("hosts"))
    ruled = among_guests.join(seen, "key").join(sets.select("key", "bands"), "key").withColumn("rule", F.struct("bucket", "root", "hosts", "bands")).select("key", "unit", "half", "rule")
    plain = in_cluster.select("key", "unit", "half").unionByName(across[0]).unionByName(across[1])
    units = staged(plain.withColumn("rule", F.lit(None).cast(ruled.schema["rule"].dataType)).unionByName(ruled), "units")

    # whole n-gram sets of the candidates only
    wanted = units.select("key").distinct().join(sets.select("key", "copy_of", "copies"), "key")
    texts = base.join(wanted.select(F.col("copy_of").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    if not wanted.filter("copy_of is null").isEmpty():  # sets that only documents without an id have
        texts = texts.unionByName(base.filter("doc_id is null").select("text"))
    full = staged(_full_sets(texts, n).dropDuplicates(["key"]).join(wanted.select("key", "copies"), "key"), "full")
    ready = units.join(full, "key").select("unit", "key", "half", "copies", "shingles", "rule")
    found = staged(by_group(ready, "unit", _verify(threshold), "a binary, b binary, n_links long"), "found")

    counts = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n_links").alias("n_links"))
    roots = components(found.filter("b is not null"))
    named = staged(sets.select("key", "copy_of", "copies").join(counts, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left"), "named")
    first = named.filter("root is not null").groupBy("root").agg(F.min("copy_of").alias("class_id"), F.min("key").alias("class_key"), F.count("*").alias("rows"))
    classed = lookup(named.filter("root is not null"), staged(first, "first"), "root", "rows").drop("root")
    alone = named.filter("root is null").drop("root").withColumns({"class_id": F.col("copy_of"), "class_key": F.col("key")})
    answer = staged(classed.unionByName(alone).select("key", "copy_of", "class_id", "class_key", "copies", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "answer")
    keyed = sketch.select("doc_id", "text_hash", "key")
    out = lookup(keyed.filter("key is not null"), answer.withColumn("weight", F.col("copies")).drop("copies"), "key", "weight").select("doc_id", "class_id", "copy_of", "n_links", "text_hash", "key", "class_key")
    return out.unionByName(keyed.filter("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), "text_hash", "key", F.col("key").alias("class_key")))


def _verify(threshold: float):
    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows < 2:
            return
        key, half, copies = group.column("key").to_pylist(), group.column("half").to_numpy(), group.column("copies").to_numpy()
        lists = [x.values.to_numpy() for chunk in group.column("shingles").chunks for x in chunk]
        rule = group.column("rule").to_pylist()
        n, edges = check_pairs(lists, copies, half, threshold, _once(rule) if rule[0] else None)
        linked = [i for i in range(len(key)) if n[i]]
        if linked:
            yield pa.RecordBatch.from_arrays([pa.array([key[i] for i in linked] + [key[a] for a, _ in edges], pa.binary()), pa.array([None] * len(linked) + [key[b] for _, b in edges], pa.binary()), pa.array([int(n[i]) for i in linked] + [0] * len(edges), pa.int64())], names=["a", "b", "n_links"])

    return run


def _once(rule: list[dict]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether a pair of guests of one bucket counts here (see above)."""
    bands = np.array([r["bands"] for r in rule])
    root, hosts, bucket = [r["root"] for r in rule], [set(r["hosts"]) for r in rule], rule[0]["bucket"]

    def counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        first = (bands[x] == bands[y]).argmax(axis=1)
        here = (bands[x, first] == bucket) & (bands[y, first] == bucket)
        apart = [root[i] != root[j] and root[i] not in hosts[j] and root[j] not in hosts[i] for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        return here & np.array(apart, dtype=bool)

    return counts


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all their columns as they are, with the least doc_id of their class (see links).

    Of repeated rows of that doc_id and text one stays. Of a class in which no row has a doc_id, one with the least set and
    hash of its text stays.
    Texts without words are in no class: all stay but repeated rows.
    """
    id_, hash_, times_ = free(docs, "class_doc", "class_hash", "class_times")
    found = staged(links(docs, threshold, n, doc_id=doc_id, text=text), "links")
    unnamed = F.col("class_id").isNull() & F.col("key").isNotNull()
    least = found.filter(unnamed & (F.col("key") == F.col("class_key"))).groupBy("class_key").agg(F.min("text_hash").alias("least"))
    named = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & ~unnamed)
    kept = named.select("doc_id", "text_hash").unionByName(found.filter(unnamed & (F.col("key") == F.col("class_key"))).join(least, "class_key").filter("text_hash = least").select("doc_id", "text_hash")).groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.count("*").alias(times_))
    kept = staged(kept, "kept")
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_))
    once = docs.join(kept.filter(F.col(times_) == 1), same, "left_semi")
    again = kept.filter(F.col(times_) > 1)
    if again.isEmpty():
        return once
    return once.unionByName(docs.join(again, same, "left_semi").dropDuplicates([doc_id, text]))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "key", "class_key")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
     shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     e AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c::DOUBLE / (nx.n + ny.n - c) >= 0.8::DOUBLE),
     reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN e ON x = b),
     class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, least(doc_id, coalesce(min(y) FILTER (WHERE same), doc_id)) AS copy_of, count(y)::BIGINT AS n_links
FROM class LEFT JOIN e ON x = doc_id GROUP BY doc_id, class_id
"""


def brute_force(docs: list[tuple[object, str | None]], threshold: float = 0.8, n: int = 5) -> dict[object, tuple[object, int]]:
    """doc_id -> (class_id, n_links), from all pairs."""
    import re

    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    root, count = list(range(len(docs))), [0] * len(docs)
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and len(x & sets[j]) / len(x | sets[j]) >= threshold:
                count[i], count[j] = count[i] + 1, count[j] + 1
                a, b = root[i], root[j]
                root = [min(a, b) if k in (a, b) else k for k in root]
    least = {}
    for (d, _), k in zip(docs, root, strict=True):
        least[k] = min(d, least.get(k, d))
    return {d: (least[k], c) for (d, _), k, c in zip(docs, root, count, strict=True)}
