"""Text records that arrive in files: cleaned as they come, counted by window of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators.corpus import with_filters

RECORD = "sent_id bigint, text string, dataset string, doc_key string, piece_no int, arrived_at timestamp_ntz"


def arriving(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    rows = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return rows.withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))


def once_each(rows: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Deliveries of the same record within ``lateness`` once; state older than that is dropped."""
    return rows.withWatermark("arrived_at", lateness).dropDuplicatesWithinWatermark(["sent_id"])


def window_counts(rows: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Records and characters by data set and window of arrival."""
    late = rows.withWatermark("arrived_at", lateness)
    return late.groupBy(F.window("arrived_at", width), "dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("n_chars")).select(
        F.col("window.start").alias("start"), "dataset", "n", "n_chars")


def too_late(rows: DataFrame, arrived: str = "arrived_at", seen: str = "_seen_at", lateness: str = "2 hours") -> DataFrame:
    """Rows that the watermark would drop, for a table of their own: ``arrived`` lies more than ``lateness`` before ``seen``, the time the
    row was read (put there with ``F.current_timestamp()``). Nothing that comes late is lost, it is only counted apart."""
    return rows.where(F.col(arrived) < F.col(seen) - F.expr(f"interval {lateness}"))


def cleaned(rows: DataFrame) -> DataFrame:
    return with_filters(rows.where("text is not null"), "text", F.col("dataset").endswith("_zh")).where("not too_long and not too_numeric")


def into_table(rows: DataFrame, path: str, checkpoint: str):
    """Appends to a parquet table until the files there are read; the checkpoint makes a repeated run go on from there."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
