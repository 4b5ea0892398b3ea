"""Documents to training shards: STAGES in order, each written as Parquet and read again by the next.

toxicity        documents that the classifier rejects go (it learns from labels, held-out rows left out)
near_copies     of each class of documents that 5-word shingles link at a similarity of 0.8, the least doc_id stays
decontaminate   documents with ten words in a row of a benchmark item go
mix             the curriculum over sources: documents once for each copy taken, in the order of training
shard           24 contiguous shards of near equal bytes in that order: doc_id, size, text_crc32, shard, slot
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm import decontam, mixing, ngram_join, sharding, toxicity
from bazaar.llm.common import free, staged


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels), toxicity.TOXIC)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs, mixing.mix(docs, mixing.rising))


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In the order of docs' files and of the rows in them, as the mix wrote them."""
    file, row = free(docs, "in_file", "in_row")
    number = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("long")  # names sort wrongly from 100 000 files on
    placed = docs.select(*docs.columns, number.alias(file), F.col("_metadata.row_index").alias(row))
    return sharding.shard_by_bytes(placed, 24, order=[file, row])


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: A learnt classifier and hashed orders are beyond SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
