"""Running values over an order of all rows, without one task for a key, however hot.

Rows are dealt out by ranges of (key, order) and sorted; each partition works on its own rows and tells what crosses its
borders in one row; the borders are carried on, partition by partition, on the driver (one row for each partition), and
what they add goes back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.operators.staging import staged


def _same(x: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before; null equals null."""
    a, b = x[1:], x[:-1]
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _place(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name += "_"
    return name


def runs(df: DataFrame, by: str, order: str, group: str | None = None, row: str = "row", run: str = "run") -> DataFrame:
    """df plus ``row``, its place among those of equal ``by`` in the order, and ``run``, the number of its run: rows in a row
    of equal ``group``, from 1; a row without a group is a run by itself. Null is a value of ``by``, first in the order;
    rows that tie in the order stand in any. group=None: no ``run``.
    """
    part, first = _place("part", df), _place("begins", df)
    names = df.columns
    key_at, group_at = names.index(by), names.index(group) if group else None

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last_key, last_group, n, r, head = TaskContext.get().partitionId(), None, None, 0, 0, True
        begun = False
        for b in batches:
            if not b.num_rows:
                continue
            key = pa.concat_arrays([pa.array([last_key], b.schema.field(key_at).type), b.column(key_at)])
            same = _same(key)
            same[0] &= begun
            starts = np.ones(b.num_rows, dtype=bool)
            if group:
                g = pa.concat_arrays([pa.array([last_group], b.schema.field(group_at).type), b.column(group_at)])
                starts = ~(same & _same(g) & pc.is_valid(g[1:]).to_numpy(zero_copy_only=False))
                last_group = g[-1].as_py()
            last_key = key[-1].as_py()
            # places in the partition since the key began, and whether that is the partition's first key
            at, fresh = np.arange(b.num_rows), np.flatnonzero(~same)
            since = np.maximum.accumulate(np.where(same, -1, at))
            rows = np.where(since < 0, n + at + 1, at - since + 1)
            total = np.cumsum(starts)
            before = np.where(since < 0, -r, (total - starts)[np.maximum(since, 0)])
            counted = total - before
            heads = np.full(b.num_rows, head)
            if len(fresh):
                heads[(fresh[1] if not begun and len(fresh) > 1 else fresh[0] if begun else b.num_rows) :] = False
            begun, head, n, r = True, bool(heads[-1]), int(rows[-1]), int(counted[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(heads), pa.array(rows.astype(np.int64)), pa.array(counted.astype(np.int64))], names=[*names, part, first, row, run])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    sorted_ = df.repartitionByRange(F.asc_nulls_first(by), F.asc_nulls_first(order)).sortWithinPartitions(F.asc_nulls_first(by), F.asc_nulls_first(order))
    placed = staged(sorted_.mapInArrow(local, f"{fields}, `{part}` int, `{first}` boolean, `{row}` long, `{run}` long"))
    what = F.struct(F.col(row).alias("row"), F.col(run).alias("run"), F.col(by).alias("key"), (F.col(group) if group else F.lit(None).cast("string")).alias("group"), F.col(first).alias("first"))
    # the first and the last row of each partition
    sides = placed.groupBy(part).agg(F.min_by(what, F.struct(~F.col(first), row)).alias("head"), F.max_by(what, F.struct(~F.col(first), F.col(by).isNotNull(), by, row)).alias("tail")).orderBy(part).collect()
    add, key, last_group, n, r, begun = [], None, None, 0, 0, False
    for s in sides:
        head, tail = s["head"], s["tail"]
        goes_on = begun and head["key"] == key
        joined = goes_on and group is not None and last_group is not None and head["group"] == last_group
        plus = (n if goes_on else 0, (r if goes_on else 0) - joined)
        add.append((s[part], *plus))
        key, last_group, begun = tail["key"], tail["group"], True
        n, r = tail["row"] + (plus[0] if tail["first"] else 0), tail["run"] + (plus[1] if tail["first"] else 0)
    more = F.broadcast(df.sparkSession.createDataFrame(add, f"`{part}` int, __more_rows long, __more_runs long"))
    out = placed.join(more, part).withColumns({row: F.col(row) + F.when(F.col(first), F.col("__more_rows")).otherwise(0), run: F.col(run) + F.when(F.col(first), F.col("__more_runs")).otherwise(0)})
    return out.select(*names, row, *([run] if group else []))
