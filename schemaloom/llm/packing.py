"""Items of varying length in containers of fixed capacity.

Containers are planned on the histogram of lengths alone (at most capacity + 1 rows, whatever the number of
items). Minimum bin slack: with the longest remaining item set, a bitset subset-sum over the remaining lengths
finds the multiset that comes closest to the capacity; backtracking gives its counts, and the container is
repeated as long as the counts last. Items then find their container by their rank within their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 512
MAX_KINDS = 1000
PLAN = "pack_name string, capacity int, length int, rank_from bigint, rank_to bigint, per_bin bigint, bin_from bigint"


def best_fill(lengths: list[int], counts: dict[int, int], space: int) -> list[tuple[int, int]]:
    """``(length, count)`` of a sub-multiset with the greatest sum up to ``space``. ``lengths`` falls."""
    mask, target = (1 << (space + 1)) - 1, 1 << space
    reach, steps = 1, []
    for length in lengths:
        if length > space:
            continue
        left, k = min(counts[length], space // length), 1
        while left > 0:  # binary parts of the count
            k = min(k, left)
            before = reach
            reach |= (reach << (length * k)) & mask
            if reach != before:
                steps.append((before, length, k))
            left, k = left - k, k * 2
        if reach & target:
            break
    total, picked = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> total & 1:
            picked[length] = picked.get(length, 0) + k
            total -= length * k
    return list(picked.items())


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, rank_from, rank_to, per_bin, bin_from)``.

    Items of ``length`` with rank in [from, to) go, ``per_bin`` at a time, into containers from ``bin_from`` on.
    Lengths are 1 to ``capacity``. A container pattern is used until one of its lengths runs short, so the
    number of patterns is bounded by the lengths and the bits of their counts, not by the items.
    """
    counts = {length: n for length, n in histogram.items() if n > 0}
    used = dict.fromkeys(counts, 0)
    lengths, rows, bins = sorted(counts, reverse=True), [], 0
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        fill = dict(best_fill(lengths, counts, capacity - top))
        counts[top] += 1
        fill[top] = fill.get(top, 0) + 1
        times = min(counts[length] // n for length, n in fill.items())
        for length, n in sorted(fill.items()):
            rows.append((length, used[length], used[length] + n * times, n, bins))
            used[length] += n * times
            counts[length] -= n * times
        bins += times
        lengths = [x for x in lengths if counts[x]]
    return rows


def container_kinds(spec: DataFrame) -> Column:
    """The kinds of container as an array literal; their table is a parameter, and more than MAX_KINDS are refused."""
    rows = spec.where("pack_name is not null and capacity > 0").select("pack_name", F.col("capacity").cast("int").alias("capacity")).distinct()
    kinds = sorted(rows.limit(MAX_KINDS + 1).collect())
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of container")
    made = [F.struct(F.lit(name).alias("pack_name"), F.lit(capacity).alias("capacity")) for name, capacity in kinds]
    return F.array(*made) if made else F.expr("cast(array() as array<struct<pack_name:string,capacity:int>>)")


def pack(items: DataFrame, item: str, size: str, spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(contents, plan)`` of every kind of container in ``spec`` (``pack_name, capacity``).

    Contents: ``pack_name, bin, item, piece, n_pieces, length``. A longer item than the capacity is cut into
    full pieces and a rest; no other is cut. A null or negative size is 0; such items fill no space and are
    dealt to the containers in turn (to container 0 if there is no other). Each ``item`` must be there once.
    Kinds without a name or a positive capacity are left out. A length with very many items is ranked in SALTS
    parts with offsets from their counts, so no task sees all of it.
    """
    kinds = container_kinds(spec)
    sized = items.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    each = sized.select("*", F.inline(kinds)).withColumn("n_pieces", F.greatest(F.ceil(F.col("size") / F.col("capacity")).cast("int"), F.lit(1)))
    pieces = each.select("pack_name", "capacity", "item", "size", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    pieces = pieces.withColumn("length", F.least(F.col("capacity"), F.col("size") - F.col("piece").cast("bigint") * F.col("capacity")).cast("int"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("item", "piece"), F.lit(SALTS)).cast("int"))

    counts = pieces.groupBy("pack_name", "capacity", "length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.groupBy("pack_name", "capacity", "length").agg(F.sum("n").alias("n"))

    def planned(group: pd.DataFrame) -> pd.DataFrame:
        name, capacity = group["pack_name"].iloc[0], int(group["capacity"].iloc[0])
        by_length = dict(zip(group["length"].astype(int), group["n"].astype(int)))
        none = by_length.pop(0, 0)
        rows = plan_bins(by_length, capacity)
        bins = max([b + (to - at) // per for _, at, to, per, b in rows], default=0)
        rows += [(0, 0, none, 0, max(bins, 1))] if none else []
        out = pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "per_bin", "bin_from"])
        return out.assign(pack_name=name, capacity=capacity)[["pack_name", "capacity", "length", "rank_from", "rank_to", "per_bin", "bin_from"]]

    # A group is the histogram of one kind of container: at most capacity + 1 rows.
    plan = histogram.groupBy("pack_name", "capacity").applyInPandas(planned, PLAN)
    parts = Window.partitionBy("pack_name", "capacity", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pack_name", "capacity", "length", "salt", "n", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("offset"))
    place = Window.partitionBy("pack_name", "capacity", "length", "salt").orderBy("item", "piece")
    local = pieces.withColumn("local", F.row_number().over(place) - 1)
    # Each part of a length takes the steps that its ranks fall into, so items meet only those, and by salted keys.
    steps = plan.groupBy("pack_name", "capacity", "length").agg(F.sort_array(F.collect_list(F.struct("rank_from", "rank_to", "per_bin", "bin_from"))).alias("steps"))
    own = F.filter("steps", lambda s: (s["rank_from"] < F.col("offset") + F.col("n")) & (s["rank_to"] > F.col("offset")))
    parts_of = offsets.join(steps, ["pack_name", "capacity", "length"]).select("pack_name", "capacity", "length", "salt", "offset", own.alias("steps"))
    placed = local.join(parts_of, ["pack_name", "capacity", "length", "salt"]).withColumn("rank", F.col("offset") + F.col("local"))
    step = F.filter("steps", lambda s: (s["rank_from"] <= F.col("rank")) & (F.col("rank") < s["rank_to"]))[0]
    placed = placed.withColumn("step", step)
    into = F.when(F.col("step.per_bin") > 0, F.col("step.bin_from") + F.floor((F.col("rank") - F.col("step.rank_from")) / F.col("step.per_bin"))).otherwise(
        F.pmod(F.col("rank"), F.col("step.bin_from"))
    )
    return placed.select("pack_name", into.cast("bigint").alias("bin"), "item", "piece", "n_pieces", "length"), plan


def bin_fill(contents: DataFrame, spec: DataFrame) -> DataFrame:
    """Per container its items, used and unused space."""
    filled = contents.groupBy("pack_name", "bin").agg(F.count(F.lit(1)).alias("n_items"), F.sum("length").cast("bigint").alias("used"))
    return filled.join(spec.select("pack_name", "capacity").distinct(), "pack_name").withColumn("slack", F.col("capacity") - F.col("used"))
