"""Problem 1: records that differ in formatting only.

Canonical records are range-partitioned on their full key and the id, sorted
externally within each partition, and scanned run by run with full keys
compared.  Keys are written once before that, since the quantiles of the ranges are
sampled in a pass of their own.  A run cut by a partition's edge takes its representative from the
edges' table, which has one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.text import letters_and_digits
from lexigrove.operators.ranges import changed, flat, range_sorted
from lexigrove.session import release, stage

_RUNS = "id long, run_id long, part int, opening boolean, first_key string, last_key string, last_run long"
_ROWS = 4096


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct (key, id) with the first id of its run; at the end one row for the edges."""
    part = TaskContext.get().partitionId()
    key_before = id_before = run = first_key = None
    opened, opening = False, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, ids = flat(batch, "key"), flat(batch, "id").to_numpy(zero_copy_only=False)
        new = changed(key, key_before, not opened)
        fresh = new.copy()
        fresh[0] |= not opened or ids[0] != id_before
        fresh[1:] |= ids[1:] != ids[:-1]
        if not opened:
            first_key, run, opened = key[0].as_py(), ids[0], True
            new[0] = False  # the partition's first run goes on from here
        starts = np.flatnonzero(new)
        at = np.searchsorted(starts, np.arange(n), side="right") - 1
        runs = np.where(at >= 0, ids[starts[np.maximum(at, 0)]] if len(starts) else run, run)
        opens = (at < 0) & opening
        if len(starts):
            opening = False
        keep = np.flatnonzero(fresh)
        for lo in range(0, len(keep), _ROWS):
            k = keep[lo : lo + _ROWS]
            none = pa.nulls(len(k), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[k]), pa.array(runs[k]), pa.array(np.full(len(k), part, np.int32)), pa.array(opens[k]), none, none, pa.nulls(len(k), pa.int64())],
                names=["id", "run_id", "part", "opening", "first_key", "last_key", "last_run"],
            )
        key_before, id_before, run = key[n - 1].as_py(), ids[-1], runs[-1]
    if opened:
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([opening]), pa.array([first_key], pa.string()), pa.array([key_before], pa.string()), pa.array([int(run)], pa.int64())],
            names=["id", "run_id", "part", "opening", "first_key", "last_key", "last_run"],
        )


def assign_representatives(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``(id, keep_id)`` for each distinct id: the smallest id among the records with the same key.

    Records with a null key or id take no part.  An id that comes twice with one
    key counts once.  Input columns other than those named are ignored; an empty
    table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), key.alias("key")).where("id IS NOT NULL AND key IS NOT NULL")
    hashed = stage(rows.select(F.xxhash64("key").alias("h"), "key", "id"), "keys")
    runs = stage(range_sorted(hashed, "h", "key", "id").select("key", "id").mapInArrow(_scan_runs, _RUNS), "runs")
    release(hashed)
    # One row per partition: the window over all of them is as long as there are partitions.
    order = Window.orderBy("part")
    edges = runs.where("last_run IS NOT NULL").select(
        "part",
        "last_run",
        (~F.coalesce(F.col("first_key") == F.lag("last_key").over(order), F.lit(False))).alias("anew"),
        F.col("opening").alias("one_run"),
    )
    # The run that ends a partition began there, unless the whole partition is one run that goes on from before.
    begun = F.when(~F.col("one_run") | F.col("anew"), F.col("last_run"))
    root = F.last(begun, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = edges.select("part", F.when(~F.col("anew"), root).alias("root"))
    members = runs.where("id IS NOT NULL").join(opened, "part", "left")
    return members.select("id", F.when(F.col("opening"), F.coalesce("root", "run_id")).otherwise(F.col("run_id")).alias("keep_id")).distinct()


def file_key(raw_json: str) -> Column:
    """Canonical title and body of a JSON file; null where it can't be parsed or says nothing.

    The members' order, other members and the way strings are escaped don't
    count; missing and null members are empty.
    """
    parsed = F.from_json(F.col(raw_json), "title STRING, body STRING, _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    whole = F.rtrim(F.col(raw_json)).endswith("}") & parsed["_corrupt_record"].isNull()
    title, body = letters_and_digits(parsed["title"]), letters_and_digits(parsed["body"])
    return F.when(whole & (F.concat(title, body) != ""), F.concat_ws("\n", title, body))


def metadata_key(title: str, length: str) -> Column:
    """Canonical title with the length; null where either says nothing."""
    name = letters_and_digits(F.col(title))
    return F.when((name != "") & F.col(length).isNotNull(), F.concat_ws("\n", name, F.col(length).cast("string")))


def collapse(members: DataFrame, df: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """``(keep_id, n_copies)``: one record for each set of copies, itself counted.

    With ``df`` its records without a key come too, each id for itself with one copy.
    """
    sets = members.groupBy("keep_id").agg(F.count("*").alias("n_copies"))
    if df is None:
        return sets
    ids = df.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    alone = ids.join(members.select("id"), "id", "left_anti")
    return sets.unionByName(alone.select(F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n_copies")))


def records(collapsed: DataFrame, df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``(keep_id, n_copies, *columns)``: the kept records themselves; of rows that repeat an id the least one."""
    row = F.struct(*(F.col(c) for c in columns))
    one = df.select(F.col(id_col).cast("long").alias("keep_id"), row.alias("row")).groupBy("keep_id").agg(F.min("row").alias("row"))
    return collapsed.join(one, "keep_id").select("keep_id", "n_copies", "row.*")


def copies(members: DataFrame) -> DataFrame:
    """``(keep_id, copy_id)`` for each record that is a copy of another."""
    return members.where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
