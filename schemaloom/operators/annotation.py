"""Tables for judging schemas by hand, and the scores of what was judged.

``instances``: ``target`` ('intra' or 'final'), ``number``, ``input``, ``pred_type, all_slots, pred_slots`` and the judgement: ``type_code`` ('1' accepted,
'2' rejected, '3' unrelated), ``type_match`` (a type of the reference schema or null). ``slots``: ``target, number, slot, code, match``; the rows with slot
'Recall' and 'Human' say whether slots have to be added from the samples or by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.operators.ranking import ranked

FIRST = 100
MARKERS = ("Recall", "Human")


def to_annotate(instances: DataFrame, target: str, score: str, only: int | None = FIRST) -> DataFrame:
    """``target, number, score, input, pred_type, all_slots, pred_slots`` with an empty judgement, numbered from the best score on.

    All slots are the union of the samples' and the chosen ones, sorted. ``only`` restricts what is to be judged by hand
    to the first numbers; None takes all.
    """
    rows = ranked(instances, [], [F.desc(score), F.col("input")], "number").withColumn("number", (F.col("number") - 1).cast("int"))
    if only is not None and target == "intra":
        rows = rows.where(F.col("number") < only)
    united = F.array_sort(F.array_union(F.coalesce("sample_slots", F.array().cast("array<string>")), F.coalesce("pred_slots", F.array().cast("array<string>"))))
    return rows.select(
        F.lit(target).alias("target"), "number", F.col(score).alias("score"), "input", "pred_type", united.alias("all_slots"), F.array_sort("pred_slots").alias("pred_slots"),
        F.lit("0").alias("type_code"), F.lit(None).cast("string").alias("type_match"))


def annotation_json(rows: DataFrame) -> DataFrame:
    """``target, number, record``: the JSON text of each row to be judged, slots as they are listed for the judge."""
    body = F.struct("score", "input", "pred_type", "all_slots", "pred_slots", F.struct(F.lit(0).alias("code"), F.col("type_match").alias("match")).alias("ann_type"), F.array().cast("array<string>").alias("ann_slots"))
    return rows.select("target", "number", F.to_json(body).alias("record"))


def quoted(text: Column) -> Column:
    """The first quoted name in a line of a report, such as ``('slot', 0.5)``."""
    return F.nullif(F.regexp_extract(text, r"'(.+?)'", 1), F.lit(""))


def schema_scores(instances: DataFrame, slots: DataFrame, reference: DataFrame, first: int = FIRST) -> DataFrame:
    """A row a target: counts of types and slots, and the percentages of overlap with the reference schema (``event_type, role``),
    of acceptance and of recall. Of 'intra' only the first judged numbers count."""
    judged = instances.where((F.col("target") != "intra") | (F.col("number") < first))
    types = reference.select("event_type").distinct().agg(F.count(F.lit(1))).scalar()
    roles = reference.where("role is not null").agg(F.count(F.lit(1))).scalar()
    of_types = judged.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_types"), F.count_distinct("type_match").alias("n_matched"), F.count_if(F.col("type_code") == "1").alias("n_accepted"),
        F.sum(F.size(F.coalesce("pred_slots", F.array().cast("array<string>")))).alias("n_slots"))
    own = slots.join(judged.select("target", "number", "type_match"), ["target", "number"])
    named = ~F.col("slot").isin(*MARKERS)
    of_slots = own.groupBy("target").agg(
        F.count_distinct(F.when(named & F.col("type_match").isNotNull(), F.col("type_match")), F.when(named, F.col("match"))).alias("n_slots_matched"),
        F.count_if(named & (F.col("code") == "1")).alias("n_slots_accepted"), F.count_if((F.col("slot") == "Recall") & (F.col("code") == "1")).alias("n_recall"))
    rows = of_types.join(of_slots, "target", "left").na.fill(0, ["n_slots_matched", "n_slots_accepted", "n_recall"])
    share = lambda a, b: F.round(F.try_divide(F.col(a) * 100.0, b), 4)
    return rows.select(
        "target", types.alias("human_types"), "n_types", share("n_matched", types).alias("type_overlap"), share("n_accepted", F.col("n_types")).alias("type_accepted"),
        roles.alias("human_slots"), "n_slots", share("n_slots_matched", roles).alias("slot_overlap"), share("n_slots_accepted", F.col("n_slots")).alias("slot_accepted"),
        share("n_recall", F.col("n_types")).alias("slot_recall"))
