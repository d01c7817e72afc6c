"""Range-partitioned operators for keys that hold most of the rows.

Rows are range-partitioned on the key *and* a secondary order, with bounds from
sampled quantiles, so a heavy key is cut into as many partitions as its share of
the rows asks for.  Each partition is sorted (spilling to disk when it must) and
scanned once; runs that touch a partition's edge are stitched from their
boundary states, of which there are at most two per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.session import stage

_SPLIT = "_split_no"


def range_sorted(df: DataFrame, *cols: str) -> DataFrame:
    """Range-partition and sort on ``cols``, then on the input partition.

    The input partition's number as last column lets even a group of identical
    rows be cut, and is the same when a lost task runs again.
    """
    keyed = df.withColumn(_SPLIT, F.spark_partition_id())
    order = [F.col(c) for c in (*cols, _SPLIT)]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop(_SPLIT)


def changed(column: pa.Array, before: object, first: bool) -> np.ndarray:
    """Where a sorted column's value differs from the one before it (nulls are equal)."""
    n = len(column)
    out = np.ones(n, dtype=bool)
    if not n:
        return out
    if not first:
        out[0] = column[0].as_py() != before
    if n > 1:
        a, b = column.slice(1), column.slice(0, n - 1)
        same = pc.fill_null(pc.equal(a, b), False)
        same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] = ~same.to_numpy(zero_copy_only=False)
    return out


def flat(batch: pa.RecordBatch, name: str) -> pa.Array:
    """One column of a batch as a plain array."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


_STATE = "key {kind}, part int, edge boolean, n_rows long, n_docs long, n_positions long, first_doc long, first_pos long, last_doc long, last_pos long"


def _scan_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per key and partition; the last key of a batch is carried on."""
    part = TaskContext.get().partitionId()
    carry: list | None = None  # key, rows, docs, positions, first doc, first pos, last doc, last pos
    opened = True
    kind: pa.DataType = pa.string()

    def emit(rows: list[list], edge: list[bool]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [pa.array(columns[0], kind), pa.array([part] * len(rows), pa.int32()), pa.array(edge, pa.bool_())]
        arrays += [pa.array(c, pa.int64()) for c in columns[1:]]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "part", "edge", "n_rows", "n_docs", "n_positions", "first_doc", "first_pos", "last_doc", "last_pos"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, doc, pos = flat(batch, "key"), flat(batch, "doc"), flat(batch, "pos")
        kind = key.type
        last = carry or [None] * 8
        new_key = changed(key, last[0], carry is None)
        new_doc = new_key | changed(doc, last[6], carry is None)
        new_pos = new_doc | changed(pos, last[7], carry is None)
        has_doc = ~pc.is_null(doc).to_numpy(zero_copy_only=False)
        has_pos = has_doc & ~pc.is_null(pos).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new_key)
        if not len(starts) or starts[0] != 0:
            starts = np.concatenate([[0], starts])
        ends = np.append(starts[1:], n)
        rows = ends - starts
        docs = np.add.reduceat((new_doc & has_doc).astype(np.int64), starts)
        poss = np.add.reduceat((new_pos & has_pos).astype(np.int64), starts)
        keys = key.take(pa.array(starts)).to_pylist()
        d0, p0 = doc.take(pa.array(starts)).to_pylist(), pos.take(pa.array(starts)).to_pylist()
        d1, p1 = doc.take(pa.array(ends - 1)).to_pylist(), pos.take(pa.array(ends - 1)).to_pylist()
        states = [list(s) for s in zip(keys, rows.tolist(), docs.tolist(), poss.tolist(), d0, p0, d1, p1)]
        if carry is not None:
            if new_key[0]:
                states.insert(0, carry)
            else:
                head = states[0]
                states[0] = [head[0], *(carry[i] + head[i] for i in (1, 2, 3)), carry[4], carry[5], head[6], head[7]]
        carry = states.pop()
        if states:
            yield emit(states, [opened] + [False] * (len(states) - 1))
            opened = False
    if carry is not None:
        yield emit([carry], [True])


def heavy_key_counts(df: DataFrame, key: str, doc: str, pos: str) -> DataFrame:
    """Per key: rows, distinct documents and distinct (document, position) pairs.

    No task gets more than its share of the rows, however heavy a key is.

    Result: ``key`` (under its own name), ``n_rows``, ``n_docs``, ``n_positions``;
    nulls form a key of their own.  A null document counts as a row but not as a
    document; a pair counts where both parts are there.  An exact repeat counts
    as a row only.  Other columns are ignored, an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(doc).cast("long").alias("doc"), F.col(pos).cast("long").alias("pos"))
    states = stage(range_sorted(rows, "key", "doc", "pos").mapInArrow(_scan_states, _STATE.format(kind=kind)), "key_states")
    by_key = Window.partitionBy("key").orderBy("part")
    same_doc = F.coalesce(F.col("first_doc") == F.lag("last_doc").over(by_key), F.lit(False))
    same_pos = same_doc & F.coalesce(F.col("first_pos") == F.lag("last_pos").over(by_key), F.lit(False))
    stitched = (
        states.where("edge")
        .select("key", "n_rows", (F.col("n_docs") - same_doc.cast("long")).alias("n_docs"), (F.col("n_positions") - same_pos.cast("long")).alias("n_positions"))
        .groupBy("key")
        .agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_docs", "n_positions")))
    )
    inner = states.where("not edge").select("key", "n_rows", "n_docs", "n_positions")
    return inner.unionByName(stitched).withColumnRenamed("key", key)


def keys_with_share(counts: DataFrame, key: str, share_numerator: int, share_denominator: int) -> DataFrame:
    """Non-null keys that hold at least the given share of all rows (nulls included in the total)."""
    total = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total")).first()["total"]
    return counts.where(F.col(key).isNotNull() & (F.col("n_rows") * share_denominator >= F.lit(total) * share_numerator)).select(key)
