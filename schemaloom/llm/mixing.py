"""Mixing sources to target shares of the total size, along a curriculum.

Each source has a weight schedule over training time 0 to 1, piecewise linear. Its integral is the share of the
budget the source has given by a time; inverting it at a document's cumulative size gives the document's
training position. Documents are then range-sorted by position. Where no schedules are given, sources that must
be repeated come late and the plentiful ones early.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of a source are the first so many hexadecimal digits of its documents' hashes.
SALT_DIGITS = 3
# Schedules: knots of (time, weight relative to the source's share); each averages 1 over the time.
FLAT = ((0.0, 1.0), (1.0, 1.0))
EARLY = ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
LATE = ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))


def source_name(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$", ""))


def integrated(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float, float]]:
    """Pieces ``(t0, t1, w0, w1, c0, c1)`` of the integral, scaled to reach 1."""
    ordered = sorted((float(t), float(w)) for t, w in knots)
    if ordered[0][0] != 0.0 or ordered[-1][0] != 1.0 or any(w < 0 for _, w in ordered):
        raise ValueError("a schedule has knots from time 0 to 1 and no negative weight")
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(ordered, ordered[1:]))
    if area <= 0:
        raise ValueError("a schedule must have some weight")
    pieces, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(ordered, ordered[1:]):
        gain = (t1 - t0) * (w0 + w1) / 2 / area
        if gain > 0:
            pieces.append((t0, t1, w0 / area, w1 / area, done, done + gain))
            done += gain
    return pieces


def position_at(fraction: Column, pieces: list[tuple[float, float, float, float, float, float]]) -> Column:
    """The time by which a source has given ``fraction`` of its demand: the integral inverted piece by piece."""
    out = F.lit(1.0)
    for t0, t1, w0, w1, c0, c1 in reversed(pieces):
        slope, rest = (w1 - w0) / (t1 - t0), fraction - c0
        if abs(slope) < 1e-12:
            step = rest / w0
        else:  # w0 x + slope x^2 / 2 = rest
            step = (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))) - w0) / slope
        out = F.when(fraction < c1, F.least(t0 + step, F.lit(t1))).otherwise(out)
    return out


def source_shares(documents: DataFrame, source: str, size: str, targets: DataFrame) -> DataFrame:
    """Per target source ``source, target_share, max_repeats, own_size, total_size, demand``.

    ``demand`` is the size that the source shall and can give: its share of the total size of all rows, at most
    ``max_repeats`` times its own size. Of a source listed more than once the largest share counts.
    """
    sizes = documents.groupBy(source_name(F.col(source)).alias("source")).agg(F.sum(size).cast("bigint").alias("own_size"))
    total = sizes.agg(F.coalesce(F.sum("own_size"), F.lit(0)).cast("bigint").alias("n")).scalar()
    wanted = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    shares = wanted.join(sizes, "source", "left").withColumn("own_size", F.coalesce("own_size", F.lit(0).cast("bigint"))).withColumn("total_size", total)
    want, can = F.coalesce(F.col("target_share"), F.lit(0.0)) * F.col("total_size"), F.coalesce(F.col("max_repeats"), F.lit(0)).cast("bigint") * F.col("own_size")
    return shares.withColumns({"wanted_size": want, "possible_size": can, "demand": F.least(want, can.cast("double"))})


def mixture(documents: DataFrame, item: str, source: str, size: str, targets: DataFrame, schedules: dict | None = None, seed: int = 5) -> DataFrame:
    """One row for each use of a document: ``item, source, epoch, size, offset, position``.

    Documents of a source follow in random order (by hash of ``item``), epoch after epoch, until the source's
    demand is met: the document during which it is met is the last. ``position`` in [0, 1) is the training time
    at which the document is due by its source's schedule. ``schedules`` maps names of sources to knots; sources
    without an entry are FLAT. Without ``schedules`` a source whose demand exceeds its own size is LATE, any other
    EARLY. Each ``item`` must be there once; documents of sources without a target, and those of size 0, aren't
    used. A source with most rows is summed in 16^SALT_DIGITS parts, whose offsets come from a table of as many
    rows a source.
    """
    rows = documents.select(F.col(item).alias("item"), source_name(F.col(source)).alias("source"), F.col(size).cast("bigint").alias("size"))
    rows = rows.where("source is not null and size > 0").withColumn("_order", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("item").cast("string"))))
    # Parts are ranges of the hash, so that part by part and within a part the order is the order of the hash.
    rows = rows.withColumn("_salt", F.substring("_order", 1, SALT_DIGITS))
    shares = source_shares(documents, source, size, targets).select("source", "own_size", "demand")
    sums = rows.groupBy("source", "_salt").agg(F.sum("size").alias("part"))
    earlier = Window.partitionBy("source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_salt", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("_before")).join(shares, "source")
    inside = Window.partitionBy("source", "_salt").orderBy("_order", "item").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["source", "_salt"])
    placed = placed.withColumn("_start", F.col("_before") + F.col("_local")).where(F.col("_start") < F.col("demand"))
    last_epoch = F.ceil((F.col("demand") - F.col("_start")) / F.col("own_size")).cast("int") - 1
    used = placed.select("item", "source", "size", "own_size", "demand", "_start", F.explode(F.sequence(F.lit(0), last_epoch)).alias("epoch"))
    used = used.withColumn("offset", F.col("_start") + F.col("epoch").cast("bigint") * F.col("own_size"))
    fraction = F.col("offset") / F.col("demand")
    if schedules is None:
        position = F.when(F.col("demand") > F.col("own_size"), position_at(fraction, integrated(LATE))).otherwise(position_at(fraction, integrated(EARLY)))
    else:
        position = position_at(fraction, integrated(FLAT))
        for name, knots in sorted(schedules.items()):
            position = F.when(F.col("source") == name, position_at(fraction, integrated(knots))).otherwise(position)
    return used.select("item", "source", "epoch", "size", "offset", position.alias("position"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The mixture range-sorted by position; ties go by source and document."""
    return mixed.orderBy("position", "source", "item", "epoch")


def reached_shares(documents: DataFrame, source: str, size: str, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per target source what the mixture holds of it: uses, size, its share, and whether the target can be reached.

    ``reached_share`` is the source's share of the mixture as it is (null if the mixture is empty), ``share_of_total``
    its used size over the size of all rows, which ``target_share`` refers to. ``ended_size`` is what the source has
    given after its last use in training order, null if it has none; it is below ``wanted_size`` where the target is
    missed.
    """
    last = F.max(F.struct("position", "offset", "size"))
    given = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_uses"), F.sum("size").cast("bigint").alias("used_size"), (last["offset"] + last["size"]).alias("ended_size"))
    shares = source_shares(documents, source, size, targets).join(given, "source", "left")
    used = F.coalesce(F.col("used_size"), F.lit(0)).cast("bigint")
    # One row a target source, so the window over all of them is small.
    everything = F.sum("used_size").over(Window.partitionBy(F.lit(0)))
    return shares.select(
        "source", "target_share", "max_repeats", "own_size", "total_size",
        F.coalesce("n_uses", F.lit(0)).cast("bigint").alias("n_uses"), used.alias("used_size"),
        F.round(F.try_divide(used, everything), 6).alias("reached_share"), F.round(F.try_divide(used, F.col("total_size")), 6).alias("share_of_total"),
        (F.col("possible_size") >= F.col("wanted_size")).alias("reachable"), "wanted_size", "ended_size",
    )
