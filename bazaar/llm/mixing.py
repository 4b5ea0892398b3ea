"""A time-varying curriculum over sources: weight schedules, demand, training positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import free, running_sums, staged

#: Words: what is between white space.
WORDS = r"[^\x20\x09-\x0D]+"


class Demand:
    """Words that a source is owed by training time t in [0, 1], in proportion to the integral of its schedule.

    schedule: (time, weight) knots from 0 to 1, weights linear between them, none negative.
    The integral is scaled so that it is ``target`` at time 1; ``when`` inverts it.
    """

    def __init__(self, schedule: Sequence[tuple[float, float]], target: float):
        t, w = np.array([x for x, _ in schedule], float), np.array([x for _, x in schedule], float)
        area = np.concatenate([[0.0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])
        scale = target / area[-1] if area[-1] else 0.0
        self.t, self.w, self.area, self.target = t, w * scale, area * scale, target

    def when(self, words: np.ndarray) -> np.ndarray:
        """The time by which more than so many words are owed, 1 at most; infinite where that is never: from the target on."""
        if not self.area[-1]:
            return np.full(len(words), np.inf)
        never, words = words >= self.target, np.minimum(words, self.area[-1])
        i = np.clip(np.searchsorted(self.area, words, side="right") - 1, 0, len(self.t) - 2)
        left, w0 = words - self.area[i], self.w[i]
        slope = (self.w[i + 1] - w0) / (self.t[i + 1] - self.t[i])
        # w0 x + slope x² / 2 = left, in the form that is stable where slope is near 0
        root = np.sqrt(np.maximum(w0 * w0 + 2 * slope * left, 0))
        x = np.where(w0 + root > 0, 2 * left / np.where(w0 + root > 0, w0 + root, 1), 0)
        return np.where(never, np.inf, np.minimum(self.t[i] + x, 1.0))


def targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares of budget by weight, none above ``most`` times its size; the excess goes to the others by weight.

    All reach their cap where budget is larger than the caps together.
    """
    out, open_ = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0]
    left = float(budget)
    while open_:
        share = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / share > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / share
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def code_points(source: str | None) -> tuple[bool, str]:
    """Order of sources: by code point, null last."""
    return source is None, source or ""


def mix(docs: DataFrame, schedule, budget_share: float = 1.0, most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The curriculum: a row for each document, with the places in training of the copies that are taken of it.

    schedule(i): knots (time, weight) of the i-th source in code point order, null last. A source's target is its
    share, by the integral of its schedule, of budget_share of all words; none above ``most`` times its words.
    Within a source documents come in an order set by a hash, over and over; the words of copy k of a document whose
    words begin at b lie about k * source_size + b + size / 2 in the source's sequence. The copy's position is the time
    by which the source is owed more words than that; a copy that is never owed is not taken.
    Columns: doc_id, source, size, source_size, target, taken (words of the document over all its copies), copies
    (array of struct<copy, position>), text_hash (xxhash64 of the text). A document with no words is taken 0 times. Null text: no words.
    Other columns of docs are not read, whatever their names. Repeated rows are documents of their own.
    A row for each source goes to the driver and to each task: sources are collections (thousands), not hosts or pages.
    """
    slim = staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash")), "words")
    totals = sorted(((r["source"], r["n"] or 0) for r in slim.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: code_points(x[0]))
    knots = [list(schedule(i)) for i in range(len(totals))]
    integral = [sum((b[1] + a[1]) / 2 * (b[0] - a[0]) for a, b in zip(k, k[1:], strict=False)) for k in knots]
    sizes = [n for _, n in totals]
    goal = targets(sizes, integral, budget_share * sum(sizes), most)
    starts = [0, *np.cumsum(np.array(sizes, dtype=np.int64)).tolist()]

    dim = slim.sparkSession.createDataFrame([(i, s) for i, (s, _) in enumerate(totals)], "rank int, source string")
    ranked = slim.alias("d").join(F.broadcast(dim).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("doc_id", "d.source", "size", "rank", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("hash"), "text_hash")
    rows = running_sums(ranked, ["rank", "hash", "doc_id", "text_hash"], "size")

    def place_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owed = [Demand(k, g) for k, g in zip(knots, goal, strict=True)]
        start, whole, aim = np.array(starts, dtype=np.int64), np.array(sizes, dtype=np.int64), np.array(goal)
        for b in batches:
            rank, size, before = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("rank", "size", "before"))
            middle = before - start[rank] + size / 2
            at, k = np.repeat(np.arange(len(size)), most), np.tile(np.arange(most), len(size))
            words, position = k * whole[rank[at]] + middle[at], np.full(len(at), np.inf)
            for r in np.unique(rank):
                own = (rank[at] == r) & (size[at] > 0)
                position[own] = owed[r].when(words[own])
            taken = np.isfinite(position)
            at, k, position = at[taken], k[taken], position[taken]
            n = np.bincount(at, minlength=len(size))
            ends = np.concatenate([[0], np.cumsum(n)])
            copies = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(k, pa.int32()), pa.array(position)], ["copy", "position"]))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("source")), pa.array(size), pa.array(whole[rank]), pa.array(aim[rank]), pa.array(size * n), copies, b.column(b.schema.get_field_index("text_hash"))], names=["doc_id", "source", "size", "source_size", "target", "taken", "copies", "text_hash"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(place_copies, f"doc_id {kind}, source string, size long, source_size long, target double, taken long, copies array<struct<copy int, position double>>, text_hash long")


def by_position(mixed: DataFrame) -> DataFrame:
    """The rows of mix with ``position``, that of their first copy, range-sorted by it: the order in which training first
    meets documents; those that aren't taken have none and come last."""
    first = mixed.withColumn("position", F.try_element_at("copies", F.lit(1))["position"])
    order = [F.asc_nulls_last("position"), F.asc_nulls_last("doc_id")]
    return first.repartitionByRange(*order).sortWithinPartitions(*order)


def apply(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all their columns as they are, once for each copy that the mix takes, sorted by position.

    Repeated rows of one doc_id and text share their copies: one of them is given as often as all are taken together.
    Columns of docs may have any names.
    """
    id_, hash_, copies_, rows_, at_ = free(docs, "mix_id", "mix_hash", "mix_copies", "mix_rows", "mix_position")
    per = mixed.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.flatten(F.collect_list("copies")).alias(copies_), F.count("*").alias(rows_))
    taken = staged(per.filter(F.size(copies_) > 0), "taken")
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_))
    chosen = docs.join(taken.filter(F.col(rows_) == 1), same)
    if not taken.filter(F.col(rows_) > 1).isEmpty():
        chosen = chosen.unionByName(docs.join(taken.filter(F.col(rows_) > 1), same).dropDuplicates([doc_id, text]))
    placed = chosen.select(*docs.columns, F.explode(F.col(copies_)["position"]).alias(at_))
    return placed.repartitionByRange(at_, doc_id).sortWithinPartitions(at_, doc_id).select(*docs.columns)


def rising(i: int) -> list[tuple[float, float]]:
    """Weights 1, 2, 3, repeating, as means over the run; each source's weight rises from half of its mean, to
    one and a half times, or falls the same way, in turn."""
    mean, slope = i % 3 + 1, 0.5 if i % 2 else -0.5
    return [(0.0, mean * (1 - slope)), (1.0, mean * (1 + slope))]


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = by_position(mix(docs, rising))
    return placed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 6).alias("position"))


# targets: sources sorted by the ratio of cap to weight fill up one after the other; the first level of the others
# that is no higher than the next ratio is theirs. position: weights are linear, so their integral is a quadratic
OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
     r AS (SELECT *, 1 + k % 3 AS w, 3.0::DOUBLE * source_size / (1 + k % 3) AS ratio, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / (1 + k % 3), source NULLS LAST) AS i FROM s),
     l AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
     t AS (SELECT source, source_size, CASE WHEN k % 2 = 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS slope, least(3.0::DOUBLE * source_size, w * (SELECT arg_min(level, i) FROM l WHERE level <= ratio)) AS target FROM l),
     b AS (SELECT d.doc_id, size, source_size, target, slope, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CASE WHEN size > 0 THEN size * least(greatest(ceil((target - middle) / source_size), 0), 3)::BIGINT ELSE 0 END AS taken,
       CASE WHEN size > 0 AND middle < target THEN round(2 * middle / (target * (1 - slope) + sqrt(target * target * (1 - slope) * (1 - slope) + 4 * slope * target * middle)), 6) END AS position
FROM b
"""
