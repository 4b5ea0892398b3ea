"""Cuts of lineage that outlive executors, and what needs them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and all of Spark is one process, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="bazaar-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: cuts lineage, survives lost executors. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_clean)
    _folders[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for path, spark in list(_folders.items()):
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before the interpreter
            pass
    _folders.clear()


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast by an estimate: of exploded or well compressed rows Spark expects too little,
    and would pass them through the driver."""
    return df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b), root being the least node; nodes without edges have no row.

    Each round moves every node to its least neighbour, if that is less, and contracts; what is left of the graph shrinks.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct())
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        to = lambda name: hop.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))  # noqa: B023, E731
        edges = staged(edges.join(large(to("a")), "a").join(large(to("b")), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct())
        if found is None:
            found = hop
        else:
            moved = found.join(large(hop.select(F.col("node").alias("root"), F.col("root").alias("next"))), "root", "left")
            found = staged(moved.select("node", F.coalesce("next", "root").alias("root")))
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
