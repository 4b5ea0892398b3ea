import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bazaar.operators import runs as module
from bazaar.operators.runs import runs


@pytest.mark.parametrize("seed", range(3))
def test_like_a_window(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2, 2, 3]), i, rng.choice([None, 5, 5, 5, 6]) if i % 60 > 20 else 9, "x") for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "channel long, at long, grp long, part string").repartition(6)
    w = Window.partitionBy("channel").orderBy("at")
    starts = (F.col("grp").isNull() | ~F.coalesce(F.col("grp") == F.lag("grp").over(w), F.lit(False))).cast("int")
    want = df.withColumn("s", starts).select("channel", "at", "grp", "part", F.row_number().over(w).alias("row"), F.sum("s").over(w).alias("run"))
    got = runs(df, "channel", "at", "grp")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, runs(df, "channel", "at").collect())) == sorted(map(str, want.drop("run").collect()))


def test_a_hot_key_is_dealt_to_all_tasks(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen, real = [], module.staged
    monkeypatch.setattr(module, "staged", lambda df: seen.append(real(df)) or seen[0])
    df = spark.range(100_000).select(F.lit(1).alias("channel"), F.col("id").alias("at"), F.floor(F.col("id") / 7).alias("grp"))
    got = runs(df, "channel", "at", "grp")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.agg(F.max("row"), F.max("run")).first() == (100_000, 14_286) and got.where("row <> at + 1 or run <> grp + 1").isEmpty()
    sizes = [r["count"] for r in seen[0].groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 40_000


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "channel long, at long, grp long")
    assert runs(df, "channel", "at", "grp").collect() == []
    one = spark.createDataFrame([(None, 1, None)], "channel long, at long, grp long")
    assert [tuple(r) for r in runs(one, "channel", "at", "grp").collect()] == [(None, 1, None, 1, 1)]
