"""Few-shot prompts from gold event records, and the completions read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.operators.corpus import seeded_sample
from schemaloom.operators.ranking import ranked

MAX_ARGUMENT = 32
MAX_GROUPS = 10_000
SEPARATOR = " & "


def type_name(event_type: Column) -> Column:
    """The part after the last of ``:`` or ``-``: the name of the type within its group."""
    return F.element_at(F.split(event_type, "[:-]"), -1)


def type_group(event_type: Column) -> Column:
    return F.element_at(F.split(event_type, "[:-]"), 1)


def prompt_line(event_type: Column, trigger: Column, target: Column, arguments: Column) -> Column:
    """``verb object & type argument ...`` in small letters."""
    return F.lower(F.concat_ws(" ", trigger, target, F.lit("&"), type_name(event_type), F.array_join(arguments, " ")))


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def sentence_line(text: Column, event_type: Column, roles: Column) -> Column:
    """``sentence & type role ...``: a whole sentence, without blanks, in place of verb and object."""
    return F.lower(F.concat_ws(" ", without_blanks(text), F.lit("&"), type_name(event_type), F.array_join(roles, " ")))


def bounded_rows(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} event groups")
    return rows


def exemplar_choice(lines: DataFrame, targets: DataFrame, group: str, line: str, target: str, k: int, seed: int = 1234) -> DataFrame:
    """For each target ``k`` exemplar lines, one a group, groups and lines drawn by hash: ``target, n, group, line``.

    Only the ``k`` best groups of a target by hash are joined to lines, and each group offers its lines by rank,
    so no target is paired with all lines.
    """
    ranked = lines.select(F.col(group).alias("_group"), F.col(line).alias("_line")).distinct()
    within = Window.partitionBy("_group").orderBy(F.md5("_line"), "_line")
    ranked = ranked.withColumn("_rank", F.row_number().over(within))
    groups = ranked.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    # Event groups are the top levels of one ontology: a list of them is a parameter of the draw.
    names = F.array(*(F.struct(F.lit(g).alias("_group"), F.lit(n).alias("_size")) for g, n in sorted(bounded_rows(groups, MAX_GROUPS))))
    key = lambda g: F.struct(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(target).cast("string"), g["_group"])).alias("h"), g["_group"].alias("g"), g["_size"].alias("s"))
    chosen = targets.select(F.col(target)).distinct().select(target, F.posexplode(F.slice(F.array_sort(F.transform(names, key)), 1, k)).alias("_no", "_pick"))
    at = F.pmod(F.conv(F.substring(F.col("_pick.h"), 1, 8), 16, 10).cast("bigint"), F.col("_pick.s")) + 1
    picked = chosen.select(F.col(target).alias("target"), (F.col("_no") + 1).alias("n"), F.col("_pick.g").alias("_group"), at.cast("int").alias("_rank"))
    return picked.join(ranked, ["_group", "_rank"]).select("target", "n", F.col("_group").alias("event_group"), F.col("_line").alias("line"))


def prompts(choice: DataFrame) -> DataFrame:
    """``target, prompt``: the chosen lines in order and, last, the target itself to be completed."""
    lines = F.array_sort(F.collect_list(F.struct("n", "line")))  # k lines a target
    joined = choice.groupBy("target").agg(lines.alias("lines"))
    return joined.select("target", F.concat_ws("\n", F.transform("lines", lambda x: x["line"]), F.concat("target", F.lit(" &"))).alias("prompt"))


def parsed_completion(raw: Column) -> Column:
    """``vo & event slot ...`` as a struct ``vo, event, slots``; nothing after the mark gives the event 'none'."""
    left, right = F.trim(F.split_part(raw, F.lit("&"), F.lit(1))), F.filter(F.split(F.trim(F.split_part(raw, F.lit("&"), F.lit(2))), r"\s+"), lambda w: w != "")
    event = F.when(F.size(right) > 1, right[0]).otherwise(F.lit("none"))
    slots = F.when(F.size(right) > 1, F.array_sort(F.array_distinct(F.slice(right, 2, F.size(right))))).otherwise(F.array().cast("array<string>"))
    return F.struct(left.alias("vo"), event.alias("event"), slots.alias("slots"))


def batches(df: DataFrame, key: str, ordinal: str, size: int = 3) -> DataFrame:
    """``df`` with ``batch`` and ``place``: every ``size`` consecutive rows of a key; an incomplete last batch is dropped."""
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    numbered = ranked(df, [key], [F.col(ordinal)], "_n").withColumn("_n", F.col("_n") - 1).join(total, key)
    numbered = numbered.withColumn("batch", F.floor(F.col("_n") / size).cast("int")).withColumn("place", (F.col("_n") % size).cast("int"))
    return numbered.where((F.col("batch") + 1) * size <= F.col("_all")).drop("_n", "_all")
