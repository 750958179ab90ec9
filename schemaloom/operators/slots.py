"""Scores of slots within an instance: TF-IDF, co-occurrence, PageRank; thresholds and event choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 1 / 3


def tfidf(local: Column, n_samples: Column, overall: Column) -> Column:
    """(1 + log10(local)^2) * log10(samples / overall count), to four places; the count is of occurrences, so it may be negative."""
    return F.round((1 + F.pow(F.log10(local), 2.0)) * F.log10(n_samples / overall), 4)


def slot_scores(slots: DataFrame) -> DataFrame:
    """``vo, slot, local, overall, tfidf, score, kept`` of rows ``vo, sample, slot`` (distinct).

    ``score`` is the min-max normalised value within the instance; where all values are equal it is null and no
    slot is kept.
    """
    n = slots.agg(F.count_distinct("vo", "sample")).scalar()
    local = slots.groupBy("vo", "slot").agg(F.count(F.lit(1)).alias("local"))
    overall = local.groupBy("slot").agg(F.sum("local").alias("overall"))
    scored = local.join(overall, "slot").withColumn("tfidf", tfidf(F.col("local"), n.cast("double"), F.col("overall")))
    w = Window.partitionBy("vo")
    low, high = F.min("tfidf").over(w), F.max("tfidf").over(w)
    scored = scored.withColumn("score", F.round(F.try_divide(F.col("tfidf") - low, high - low), 4))
    return scored.withColumn("kept", F.coalesce(F.col("score") >= THRESHOLD, F.lit(False)))


def slot_pairs(slots: DataFrame) -> DataFrame:
    """``a, b, n``: how often two slots meet in a sample (``a < b``), counted in both orders.

    Pairs are made inside each sample's own sorted array, not by a join of all rows.
    """
    gathered = slots.groupBy("vo", "sample").agg(F.array_sort(F.collect_set("slot")).alias("s"))  # the slots of one sentence
    left = gathered.select("s", F.posexplode("s").alias("i", "a"))
    pairs = left.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg((2 * F.count(F.lit(1))).alias("n"))


def instance_edges(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weighted edges between the kept slots of every instance: ``vo, a, b, w``."""
    kept = scored.where("kept").groupBy("vo").agg(F.array_sort(F.collect_set("slot")).alias("s"))  # bounded by the samples of an instance
    left = kept.select("vo", "s", F.posexplode("s").alias("i", "a"))
    inside = left.select("vo", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return inside.join(pairs, ["a", "b"]).select("vo", "a", "b", F.col("n").cast("double").alias("w"))
