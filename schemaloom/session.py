"""Session settings and the helpers every module shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space as Unicode defines it, plus the four ASCII separators.
BLANK = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def session(app: str = "schemaloom", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Use the shared folder that the session names; a folder of its own gets only a local session without one (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("SCHEMALOOM_CHECKPOINTS")
        if not shared and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="schemaloom-"))
    return spark


def squeeze(text: Column) -> Column:
    """Trimmed text with every run of white space made one blank."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return text.isNull() | ~F.coalesce(text, F.lit("")).rlike(r"[^\t-\r\x1c-\x20\x85\p{Z}]")


def deliver_once(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row per record id; of deliveries that differ, the one whose columns sort first.

    A null id identifies nothing, so such rows count as the same record only if their columns are equal.
    """
    kept = df.select(F.col(id_col).alias("_id"), F.struct(*columns).alias("_row"))
    other = F.when(F.col("_id").isNull(), F.xxhash64("_row")).alias("_null_key")
    once = kept.groupBy("_id", other).agg(F.min("_row").alias("_row"))
    return once.select(F.col("_id").alias(id_col), *(F.col("_row")[c].alias(c) for c in columns if c != id_col))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for steps that cost far more than a shuffle of it.

    Tables of enough files stay as they are; only a table too small to be split is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
