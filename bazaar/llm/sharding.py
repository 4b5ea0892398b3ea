"""Contiguous shards of near equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import running_sums, staged


def shard_by_bytes(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = 8, order: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: documents in a global order, cut at equal bytes.

    size is the UTF-8 bytes of the text (null: none) plus overhead. A document lies in the shard that holds the
    middle of its bytes in the global order, so each shard's bytes differ from the target by less than one
    document at either end. The order is that of (MD5 of the text, doc_id): equal texts are neighbours, so of their
    groups only those that lie on one of the n_shards - 1 cuts are in more than one shard, whatever their size. With
    ``order``, columns that end in one of distinct values, it is the order of these. slot numbers a shard's documents
    from 0 in the global order. Null and empty texts are one group (crc32 of no bytes); null doc_ids come first;
    repeated rows get a slot each; no rows, no shards; other columns of docs are not read, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + overhead).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.substring(F.md5(body.cast("binary")), 1, 16).alias("hash"), *(F.col(c).alias(f"order{i}") for i, c in enumerate(order or [])))
    by = [f"order{i}" for i in range(len(order))] if order else ["hash", "text_crc32", "size", "doc_id"]
    rows = running_sums(staged(slim, "sizes"), by, "size")
    total = rows.agg(F.sum("size")).first()[0] or 1
    middle = F.col("before") + F.col("size") / 2
    shard = F.least(F.floor(middle * n_shards / total), F.lit(n_shards - 1)).cast("int")
    placed = staged(rows.select("doc_id", "size", "text_crc32", "row", shard.alias("shard")), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs, 24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_BYTE_CRC = "list_reduce(list_prepend(i::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
OP5_SQL = f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, {_BYTE_CRC} AS c FROM range(0, 256) r(i))),
     d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
     s AS (SELECT doc_id, octet_length(encode(body)) + 8 AS size, substr(md5(body), 1, 16) AS hash,
                  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda b: ('0x' || b)::BIGINT)),
                      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM d, crc),
     o AS (SELECT *, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, row_number() OVER w AS row, (sum(size) OVER ())::BIGINT AS total
           FROM s WINDOW w AS (ORDER BY hash, text_crc32, size, doc_id)),
     p AS (SELECT *, least(floor((before + size / 2.0::DOUBLE) * 24 / total), 23)::INTEGER AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row - min(row) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM p
"""
