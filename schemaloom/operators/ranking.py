"""Row numbers over data of any size and skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.session import with_checkpoints


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with ``out``, the row's number (from 1) within ``keys`` by ``order``; without keys, over all rows.

    Rows are range-partitioned by keys and order, so a key with most rows spreads over many partitions; each
    numbers its own rows, and offsets come from a table of one row a key and partition. The partitioning is
    checkpointed, as a second sampling might draw other borders. ``order`` should tell all rows apart.
    """
    with_checkpoints(df.sparkSession)
    numbered = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = numbered.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    local = numbered.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    match = F.col("l._part") == F.col("o._part")
    for k in keys:
        match &= F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = local.alias("l").join(offsets.alias("o"), match)
    return joined.select("l.*", (F.col("o._offset") + F.col("l._local")).alias(out)).drop("_part", "_local")
