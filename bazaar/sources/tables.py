"""Tables as folders of Parquet under one manifest, and the readers of configuration and of curated JSON.

A manifest, ``root/_manifest/<number>.json``, says of which folders each table consists; that of the highest number
holds. A write makes a new folder; it counts from when a manifest lists it. So an append writes only its own rows, a
transaction switches all its tables at once, and what a failed one wrote is never read. Readers of an older state go on
undisturbed while its folders are kept. One writer at a time.

Rows of a table with ids lie in folders of a block of ids each. Ids grow with time, so an update by id, which rewrites the
blocks that it touches, leaves what is old as it is.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar import schema
from bazaar.operators.ids import number
from bazaar.operators.ingest import absent


#: Manifests, and the folders that they list, that are kept beside the current one.
KEEP = 2
#: Ids of a block.
BLOCK = 1 << 20


class Store:
    """Named tables under a root that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, block: int = BLOCK):
        """block: ids of a block; it is a property of the store, and the same at each opening."""
        self.spark, self.root, self.block = spark, root.rstrip("/"), block
        self._open: dict[str, list[str]] | None = None  # the state that a transaction will leave

    def _path(self, text: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _list(self, text: str) -> list[str]:
        fs, p = self._path(text)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _manifests(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._list(f"{self.root}/_manifest") if n.endswith(".json") and n[:-5].isdigit())

    def _state(self, number: int) -> dict[str, list[str]]:
        rows = self.spark.read.text(f"{self.root}/_manifest/{number:012}.json", wholetext=True)
        return json.loads(rows.first()[0])

    def state(self) -> dict[str, list[str]]:
        """Folders of each table, as the transaction that is open left them, else as the current manifest says."""
        have = self._manifests() if self._open is None else []
        return self._open if self._open is not None else self._state(have[-1]) if have else {}

    def _commit(self, state: dict[str, list[str]]) -> None:
        have = self._manifests()
        n = have[-1] + 1 if have else 0
        fs, new = self._path(f"{self.root}/_manifest/.{n}-{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(new, self._path(f"{self.root}/_manifest/{n:012}.json")[1]):
            raise RuntimeError("another writer has committed meanwhile")
        old = have[: max(0, len(have) - KEEP)]
        kept = {f for m in [*have[len(old) :], n] for fs_ in self._state(m).values() for f in fs_}
        for m in old:
            gone = {f for fs_ in self._state(m).values() for f in fs_} - kept
            for folder in gone:
                self._drop(f"{self.root}/{folder}")
            for write in {f.rpartition("/")[0] for f in gone if "/__block=" in f}:
                if not any(n.startswith("__block=") for n in self._list(f"{self.root}/{write}")):
                    self._drop(f"{self.root}/{write}")
            self._drop(f"{self.root}/_manifest/{m:012}.json")

    def _drop(self, text: str) -> None:
        fs, p = self._path(text)
        fs.delete(p, True)

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Writes inside count together when it ends, and not at all if it fails; one inside another is part of that."""
        if self._open is not None:
            yield
            return
        self._open = dict(self.state())
        try:
            yield
            self._commit(self._open)
        finally:
            self._open = None

    @staticmethod
    def _block(folder: str) -> int | None:
        """The block of ids of a folder; None for one of any ids."""
        found = folder.rpartition("/__block=")[2]
        return int(found) if found.isdigit() else None

    def _within(self, name: str, blocks: set[int]) -> list[str]:
        return [f for f in self.state().get(name, []) if self._block(f) is None or self._block(f) in blocks]

    def _touched(self, rows: DataFrame) -> set[int]:
        """Blocks of the ids of rows."""
        return {r[0] for r in rows.select(F.floor(F.col("id") / self.block)).distinct().collect() if r[0] is not None}

    def read(self, name: str) -> DataFrame:
        """The table as it stands; an empty one of the declared columns if it was never written."""
        return self._read(name, self.state().get(name, []))

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return schema.empty(self.spark, name)
        found = self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*(f"{self.root}/{f}" for f in folders))
        for f in schema.struct(name):
            if f.name not in found.columns:
                found = found.withColumn(f.name, F.lit(None).cast(f.dataType))
        return found

    def _add(self, name: str, df: DataFrame) -> list[str]:
        folder = f"{name}/{uuid.uuid4().hex}"
        if dict(df.dtypes).get("id") not in ("bigint", "int"):
            df.write.parquet(f"{self.root}/{folder}")
            return [folder]
        # a block is written by one task, so it is one file
        blocks = df.withColumn("__block", F.floor(F.col("id") / self.block)).repartition("__block")
        blocks.write.partitionBy("__block").parquet(f"{self.root}/{folder}")
        return [f"{folder}/{n}" for n in sorted(self._list(f"{self.root}/{folder}")) if n.startswith("__block=")]

    def write(self, name: str, df: DataFrame) -> None:
        """df in place of the table."""
        folders = self._add(name, df)
        with self.transaction():
            self._open[name] = folders

    def append(self, name: str, df: DataFrame) -> None:
        """The table and df, which alone is written."""
        folders = self._add(name, df)
        with self.transaction():
            self._open[name] = [*self._open.get(name, []), *folders]

    def last_id(self, name: str) -> int:
        """The largest id, 0 if there is none; looked up in the last block."""
        known = [b for b in map(self._block, self.state().get(name, [])) if b is not None]
        return self._read(name, self._within(name, {max(known, default=0)})).agg(F.max("id")).first()[0] or 0

    def insert(self, name: str, rows: DataFrame, keys: list[str] | None = None, order: list | None = None) -> int:
        """Appends rows with ids behind the last; with keys, only those that are not there yet. How many."""
        now = near = self.read(name)
        if keys:
            # of what is there only rows between the least and the largest new key are looked at, which Parquet's statistics find
            ends = rows.agg(*(f(k).alias(f"{f.__name__}_{i}") for i, k in enumerate(keys) for f in (F.min, F.max))).first()
            for i, k in enumerate(keys):
                near = near.where(F.col(k).between(F.lit(ends[f"min_{i}"]), F.lit(ends[f"max_{i}"])))
            rows = absent(rows, near, keys)
        new = number(rows.drop("id"), order or keys or rows.drop("id").columns[:1], self.last_id(name) + 1)
        added = new.count()
        if added:
            kinds = {f.name: f.dataType for f in now.schema}
            self.append(name, new.select(*(F.col(c).cast(kinds[c]).alias(c) for c in new.columns if c in kinds)))
        return added

    def _swap(self, name: str, blocks: set[int], df: DataFrame) -> None:
        """df in place of all rows of these blocks, and of folders of any ids."""
        folders, gone = self._add(name, df), self._within(name, blocks)
        with self.transaction():
            self._open[name] = [f for f in self._open.get(name, []) if f not in gone] + folders

    def update(self, name: str, changes: DataFrame, key: str = "id") -> None:
        """Writes the columns of changes over the rows of the same key; no columns, no change. By id, only blocks with
        changes are read and written."""
        own = [c for c in changes.columns if c != key]
        if not own:
            return
        if key == "id":
            blocks = self._touched(changes)
            if blocks:
                self._swap(name, blocks, updated(self._read(name, self._within(name, blocks)), changes))
        else:
            self.write(name, updated(self.read(name), changes, key))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows in place of those of the same ids, or beside what there is; only their blocks are read and written."""
        blocks = self._touched(rows)
        if blocks:
            old = self._read(name, self._within(name, blocks)).join(rows.select("id"), "id", "left_anti")
            self._swap(name, blocks, old.unionByName(rows.select(*old.columns)))

    def migrate(self, steps: dict[str, callable], at: datetime) -> list[str]:
        """Runs steps (name to function of the store) that were not run before, by name; the names of those."""
        done = {r["name"] for r in self.read("schema_migration").collect()}
        todo = sorted(set(steps) - done)
        for step in todo:
            steps[step](self)
            row = self.spark.createDataFrame([(step, at)], schema.struct("schema_migration"))
            self.append("schema_migration", row)
        return todo


def updated(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """table with the columns of changes written over rows of the same key, nulls included."""
    own = [c for c in changes.columns if c != key]
    news = changes.select(key, F.struct(*own).alias("__new"))
    return table.join(news, key, "left").select(*(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in table.columns))


def backfill_photos(photos: Column, photo: Column) -> Column:
    return F.coalesce(photos, F.when(photo.isNotNull(), F.array(photo)))


def load_channels(spark: SparkSession, path: str) -> DataFrame:
    """(username, title, trust) of a YAML file whose ``channels`` are names or mappings; without @; no file, none."""
    rows = []
    if os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            for c in (yaml.safe_load(f) or {}).get("channels") or []:
                c = {"username": c} if isinstance(c, str) else c
                rows.append((str(c["username"]).lstrip("@"), c.get("title"), int(c.get("trust", 50))))
    return spark.createDataFrame(rows, "username string, title string, trust int")


def load_locations(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records."""
    return spark.read.option("multiLine", True).schema(schema.struct("location")).json(path)


def load_refinements(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of refinements by id, as rows; no file, none."""
    from bazaar.operators.curate import REFINEMENT

    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"id string, {REFINEMENT}")
    kind = REFINEMENT.replace(" struct<", ":struct<").replace(" string,", ":string,").replace(" boolean", ":boolean")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{kind}>>")).alias("id", "r")).select("id", "r.*")


def dumps(value: Column) -> Column:
    return F.to_json(value)


def loads(text: Column, kind: str, default: Column) -> Column:
    """JSON as ``kind``; what is not such JSON gives the default."""
    return F.coalesce(F.from_json(text, kind), default)
