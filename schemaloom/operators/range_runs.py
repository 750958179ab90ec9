"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on the composite key (key, value, piece) with Spark's sampled quantiles, so a
heavy key spreads over as many partitions as its rows need. Each partition is sorted externally and scanned
once for runs of equal (key, value). Runs inside a partition are final; only the first and the last run of a
partition can continue in a neighbour, so these travel on as partial states and are stitched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLUSH_ROWS = 200_000


def combine_map_side(df: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of equal (key, value) within a task, before any shuffle: ``key, value, piece, n``."""
    kinds = dict(df.select(key, value).dtypes)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held, seen = TaskContext.get(), [], 0
        task = context.partitionId() if context else 0

        def flush(piece: int) -> pa.RecordBatch:
            got = pa.Table.from_batches(held).group_by(["key", "value"]).aggregate([([], "count_all")])
            out = pa.table({
                "key": got["key"], "value": got["value"],
                "piece": pa.array(np.full(len(got), (task << 24) + piece, np.int64)), "n": got["count_all"],
            })
            return out.combine_chunks().to_batches()[0]

        pieces = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            seen += batch.num_rows
            if seen >= FLUSH_ROWS:
                yield flush(pieces)
                held, seen, pieces = [], 0, pieces + 1
        if seen:
            yield flush(pieces)

    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value")).where("key is not null and value is not null")
    return rows.mapInArrow(combine, f"key {kinds[key]}, value {kinds[value]}, piece bigint, n bigint")


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted (key, value, n) rows.

    Yields ``is_run`` rows for the two boundary runs and, for the runs between them, one mergeable state per
    key and batch: rows, distinct values, and the value with most rows (smallest of equals).
    """
    carry: pa.Table | None = None
    first_out = False

    def runs_of(rows: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray]:
        key, value = (rows[c].combine_chunks() for c in ("key", "value"))
        change = np.ones(len(rows), bool)
        if len(rows) > 1:
            differs = pc.or_(pc.not_equal(key[1:], key[:-1]), pc.not_equal(value[1:], value[:-1]))
            change[1:] = differs.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(change)
        sums = np.add.reduceat(rows["n"].to_numpy(), starts)
        return key.take(pa.array(starts)), value.take(pa.array(starts)), sums

    def out(is_run: bool, key: pa.Array, rows: np.ndarray, values: np.ndarray, top: pa.Array, top_n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({
            "is_run": pa.array(np.full(len(key), is_run)), "key": key, "n_rows": pa.array(rows, pa.int64()),
            "n_values": pa.array(values, pa.int64()), "top": top, "n_top": pa.array(top_n, pa.int64()),
        })

    def boundary(key: pa.Array, value: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return out(True, key, n, np.ones(len(n), np.int64), value, n)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).select(["key", "value", "n"])
        if carry is not None:
            rows = pa.concat_tables([carry, rows])
        key, value, n = runs_of(rows)
        carry = pa.Table.from_arrays([key[-1:], value[-1:], pa.array(n[-1:], pa.int64())], schema=rows.schema)
        key, value, n = key[:-1], value[:-1], n[:-1]
        if len(n) and not first_out:
            yield boundary(key[:1], value[:1], n[:1])
            first_out, key, value, n = True, key[1:], value[1:], n[1:]
        if not len(n):
            continue
        change = np.ones(len(n), bool)
        if len(n) > 1:
            change[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(change)
        length = np.diff(np.append(starts, len(n)))
        best = np.maximum.reduceat(n, starts)
        place = np.where(n == np.repeat(best, length), np.arange(len(n)), len(n))
        at = np.minimum.reduceat(place, starts)
        yield out(False, key.take(pa.array(starts)), np.add.reduceat(n, starts), length, value.take(pa.array(at)), best)
    if carry is not None:
        yield boundary(carry["key"].combine_chunks(), carry["value"].combine_chunks(), carry["n"].to_numpy())


def per_key_states(weighted: DataFrame) -> DataFrame:
    """Of ``key, value, piece, n``: per key ``key, n_rows, n_values, top, n_top`` without a hot task.

    Null keys and values must have been removed. An empty input gives an empty result.
    """
    kinds = {f.name: f.dataType for f in weighted.schema}
    ranged = weighted.repartitionByRange("key", "value", "piece").sortWithinPartitions("key", "value")
    schema = T.StructType([
        T.StructField("is_run", T.BooleanType()), T.StructField("key", kinds["key"]), T.StructField("n_rows", T.LongType()),
        T.StructField("n_values", T.LongType()), T.StructField("top", kinds["value"]), T.StructField("n_top", T.LongType()),
    ])
    states = ranged.select("key", "value", "n").mapInArrow(scan_runs, schema)
    # Boundary runs meet in one group each: at most two rows a partition come here.
    run_key = [F.col("key"), F.when(F.col("is_run"), F.col("top")), F.when(~F.col("is_run"), F.xxhash64("top", "n_rows", "n_values", "n_top"))]
    met = states.groupBy(run_key[0], "is_run", run_key[1].alias("run"), run_key[2].alias("other")).agg(
        F.sum("n_rows").alias("n_rows"),
        F.when(F.col("is_run"), F.lit(1)).otherwise(F.sum("n_values")).cast("bigint").alias("n_values"),
        F.min("top").alias("top"),
        F.when(F.col("is_run"), F.sum("n_top")).otherwise(F.max("n_top")).alias("n_top"),
    )
    return met.groupBy("key").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_values").alias("n_values"),
        F.min(F.struct((-F.col("n_top")).alias("n"), F.col("top").alias("top"))).alias("_best"),
    ).select("key", "n_rows", "n_values", F.col("_best.top").alias("top"), (-F.col("_best.n")).alias("n_top"))


def heavy_key_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key its number of rows and of distinct values and its most frequent value (equals: the smallest).

    Rows with a null key or value are left out; repeated rows each count; other columns are ignored, whatever
    their names. ``df`` may be empty. Columns: ``key, n_rows, n_values, top, n_top``.
    """
    return per_key_states(combine_map_side(df, key, value))
