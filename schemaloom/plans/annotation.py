"""Queries of the tables for judging and of the scores of judgements.

No one judges here: an event type of the gold records is an instance, its roles are its slots, and the judgement follows
from their spelling, so that the scores can be checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import annotation as op
from schemaloom.plans import prompts
from schemaloom.session import deliver_once, table


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """``input, score, pred_type, sample_slots, pred_slots``: roles used at least three times are the chosen slots."""
    gold = deliver_once(table(spark, d, "train_oneie"), "inst_id", ["inst_id", "event_mentions"])
    used = gold.select(F.explode("event_mentions").alias("e")).select("e.event_type", F.explode("e.arguments").alias("a")).select("event_type", F.col("a.role").alias("role")).where("event_type is not null and role is not null")
    counted = used.groupBy("event_type", "role").agg(F.count(F.lit(1)).alias("n"))
    chosen = F.filter(F.collect_list(F.when(F.col("n") >= 3, F.col("role"))), lambda x: x.isNotNull())
    rows = counted.groupBy("event_type").agg(F.sum("n").alias("score"), F.collect_list("role").alias("sample_slots"), chosen.alias("pred_slots"))
    return rows.select(F.col("event_type").alias("input"), "score", F.lower("event_type").alias("pred_type"), "sample_slots", "pred_slots")


def to_annotate(spark: SparkSession, d: str) -> DataFrame:
    rows = op.to_annotate(predicted(spark, d), "intra", "score")
    return rows.select("target", "number", "score", "input", "pred_type", F.array_join("all_slots", " ").alias("all_slots"), F.array_join("pred_slots", " ").alias("pred_slots"))


def judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = op.to_annotate(predicted(spark, d), "intra", "score").withColumn("type_code", F.when(F.length("input") % 3 == 0, "2").otherwise("1"))
    rows = rows.withColumn("type_match", F.when(F.col("type_code") == "1", F.col("input")))
    slot = rows.select("target", "number", "type_match", F.explode("pred_slots").alias("slot"))
    slot = slot.withColumn("code", F.when(F.length("slot") % 2 == 0, "1").otherwise("2"))
    slots = slot.select("target", "number", "slot", "code", F.when((F.col("code") == "1") & F.col("type_match").isNotNull(), F.col("slot")).alias("match"))
    extra = rows.select("target", "number", F.lit("Recall").alias("slot"), F.when(F.size("all_slots") > F.size("pred_slots"), "1").otherwise("2").alias("code"), F.lit(None).cast("string").alias("match"))
    return rows, slots.unionByName(extra)


def scores(spark: SparkSession, d: str) -> DataFrame:
    gold = prompts.role_sets(spark, d).select("event_type", F.explode(F.split("roles", " ")).alias("role"))
    return op.schema_scores(*judged(spark, d), gold)


QUERIES = {"annotation_table": to_annotate, "annotation_scores": scores}

_A = """WITH gold AS (SELECT DISTINCT inst_id, event_mentions FROM train_oneie), e AS (SELECT unnest(event_mentions) AS e FROM gold),
u AS (SELECT event_type, a.role AS role FROM (SELECT e.event_type AS event_type, unnest(e.arguments) AS a FROM e) WHERE event_type IS NOT NULL AND a.role IS NOT NULL),
c AS (SELECT event_type, role, count(*) AS n FROM u GROUP BY ALL),
p AS (SELECT event_type AS input, sum(n)::BIGINT AS score, lower(event_type) AS pred_type, list(role ORDER BY role) AS all_slots, coalesce(list(role ORDER BY role) FILTER (n >= 3), []) AS pred_slots FROM c GROUP BY event_type),
n AS (SELECT *, (row_number() OVER (ORDER BY score DESC, input) - 1)::INT AS number FROM p QUALIFY number < 100)
"""
SQL = {
    "annotation_table": _A + "SELECT 'intra' AS target, number, score, input, pred_type, array_to_string(all_slots, ' ') AS all_slots, array_to_string(pred_slots, ' ') AS pred_slots FROM n",
    "annotation_scores": _A + """, j AS (SELECT *, length(input) % 3 <> 0 AS ok FROM n), s AS (SELECT number, ok, input, unnest(pred_slots) AS slot FROM j),
h AS (SELECT count(DISTINCT event_type) AS ht, count(*) AS hs FROM c)
SELECT 'intra' AS target, ht AS human_types, count(*) AS n_types, round(count(*) FILTER (ok) * 100.0::DOUBLE / ht, 4) AS type_overlap, round(count(*) FILTER (ok) * 100.0::DOUBLE / count(*), 4) AS type_accepted,
hs AS human_slots, sum(len(pred_slots))::BIGINT AS n_slots, round((SELECT count(DISTINCT (input, slot)) FROM s WHERE ok AND length(slot) % 2 = 0) * 100.0::DOUBLE / hs, 4) AS slot_overlap,
round((SELECT count(*) FROM s WHERE length(slot) % 2 = 0) * 100.0::DOUBLE / sum(len(pred_slots)), 4) AS slot_accepted, round(count(*) FILTER (len(all_slots) > len(pred_slots)) * 100.0::DOUBLE / count(*), 4) AS slot_recall
FROM j, h GROUP BY ht, hs""",
}
