"""What the operators share: staging in the shared folder, skew-safe lookups, global running sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows is heavy. At most 1 / HEAVY_SHARE keys can be,
#: whatever the size of the data, so a table of them may be broadcast.
HEAVY_SHARE = 1 / 2000
#: Keys of fewer rows than this are never heavy.
HEAVY_LEAST = 200

_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset: a temporary one if all of Spark is one process, as
    in tests; else ValueError, as no other machine would see it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        # the setting itself can't be changed in a running session
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="bazaar-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_clean)
    _staged[path] = spark
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)
    _staged.pop(path, None)


def _clean() -> None:
    for path, spark in list(_staged.items()):
        try:
            drop_dir(spark, path)
        except Exception:  # the session may have ended before the interpreter
            _staged.pop(path, None)


def staged(df: DataFrame, name: str, rows_of_file: int = 0) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    rows_of_file: most rows of a file (0: any number). Where a row is megabytes of arrays, Spark's reader would else hold thousands at once.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("maxRecordsPerFile", rows_of_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def release(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more, and lets Spark's cleaner drop the shuffle files of
    finished steps, which stay until the driver collects its garbage."""
    for df in tables:
        names = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        for path in [p for p in _staged if p.rpartition("/")[2] in names]:
            drop_dir(df.sparkSession, path)
    SparkSession.getActiveSession().sparkContext._jvm.System.gc()


def lookup(facts: DataFrame, dim: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of facts with dim, which has a row per key; weight: how many rows of facts have the key.

    Heavy keys (at most 2000, see HEAVY_SHARE) are joined by broadcast, so no task gets all rows of one;
    the others by shuffle. Both inputs should be staged: they are read twice. Null keys match nothing.
    """
    spark = facts.sparkSession
    total, most = dim.agg(F.sum(weight), F.max(weight)).first()
    least = max(HEAVY_LEAST, int((total or 0) * HEAVY_SHARE))
    if (most or 0) < least:
        return facts.join(dim.drop(weight), key)
    heavy = dim.filter(F.col(weight) >= least).drop(weight)
    light = dim.filter(F.col(weight) < least).drop(weight)
    keys = [r[0] for r in heavy.select(key).collect()]
    known = F.broadcast(spark.createDataFrame([(k,) for k in keys], heavy.select(key).schema))
    return facts.join(F.broadcast(heavy), key).unionByName(facts.join(known, key, "left_anti").join(light, key))


def running_sums(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """df with ``before`` (sum of value in all rows ahead in the global order) and ``row`` (their count).

    Rows are range-partitioned by ``order`` and sorted; each partition adds up its own rows, the totals of
    the partitions (one row each) go to the driver, and their prefix sums are added to the rows.
    No partition depends on a key's number of rows as long as ``order`` ends in a column of distinct values.
    """
    spark = df.sparkSession
    kept = df.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, total, rows = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            v = np.asarray(b.column(kept.index(value)).to_numpy(zero_copy_only=False), dtype=np.int64)
            ahead = total + np.cumsum(v) - v
            row = rows + np.arange(len(v))
            total, rows = total + int(v.sum()), rows + len(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ahead), pa.array(row), pa.array(np.full(len(v), pid, dtype=np.int32))], names=[*kept, "before", "row", "pid"])

    # REPARTITION_BY_COL: the number of partitions is Spark's setting, so it follows the cluster
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = staged(ranged.mapInArrow(local, f"{fields}, before long, row long, pid int"), "running")
    totals = rows.groupBy("pid").agg(F.max(F.struct("row", "before", value)).alias("last")).select("pid", F.col("last.row").alias("r"), (F.col("last.before") + F.col(f"last.{value}")).alias("s")).collect()
    at, s, n = [], 0, 0
    for r in sorted(totals):
        at.append((r["pid"], s, n))
        s, n = s + r["s"], n + r["r"] + 1
    ahead = F.broadcast(spark.createDataFrame(at, "pid int, s0 long, r0 long"))
    return rows.join(ahead, "pid").withColumns({"before": F.col("before") + F.col("s0"), "row": F.col("row") + F.col("r0")}).select(*kept, "before", "row")


def by_group(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """fn(pa.Table of one group) -> list of pa.RecordBatch, for each value of key; rows in the order of df's sort.

    Groups should be of bounded size: one at a time is held. df is dealt out by key here; ``fn`` sees whole groups.
    """
    names = df.columns
    at = names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(at)
            if pa.types.is_integer(k.type):
                v = k.to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(v[1:] != v[:-1]) + 1
            else:
                v = k.to_pylist()
                cuts = [i for i in range(1, len(v)) if v[i] != v[i - 1]]
            if held and v[0] != last:
                yield from fn(pa.Table.from_batches(held))
                held = []
            lo = 0
            for c in [*cuts, b.num_rows]:
                held.append(b.slice(lo, c - lo))
                if c < b.num_rows:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                lo = c
            last = v[-1]
        if held:
            yield from fn(pa.Table.from_batches(held))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b): root is the least node of the component.

    Each round points every node to its least neighbour or itself, and contracts; rounds go on while edges
    between different roots are left, over a graph that shrinks. Nothing but counts goes to the driver.
    """
    spark = edges.sparkSession
    edges = staged(edges.select("a", "b").filter("a <> b and a is not null and b is not null").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        hop = staged(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("root"), F.count("*").alias("n")), "hop")
        rounds.append(hop)
        left = lookup(edges.select(F.col("a").alias("node"), "b"), hop, "node", "n").select(F.col("root").alias("ra"), F.col("b").alias("node"))
        edges = staged(lookup(left, hop, "node", "n").select(F.col("ra").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct(), "edges")
    if not rounds:
        return spark.createDataFrame([], f"node {dict(edges.dtypes)['a']}, root {dict(edges.dtypes)['a']}")
    found = rounds[0].select("node", "root")
    for hop in rounds[1:]:
        # roots that the round didn't move have no row in hop
        sizes = found.groupBy("root").agg(F.count("*").alias("n"))
        step = staged(hop.select(F.col("node").alias("root"), F.col("root").alias("next")).join(sizes, "root"), "step")
        moved = lookup(found, step, "root", "n").select("node", F.col("next").alias("root"))
        found = staged(moved.unionByName(found.join(step.select("root"), "root", "left_anti").select("node", "root")), "roots")
    return found
