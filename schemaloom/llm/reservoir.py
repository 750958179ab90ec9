"""A uniform sample of fixed size from data of unknown length.

Every partition keeps a reservoir by skips (Algorithm L: the number of records to pass over is drawn, not a
number per record) and counts what it saw. Reservoirs merge in a tree: of two or more, the number of records
that each gives is a multivariate hypergeometric draw by the populations they stand for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN_IN = 8
ROWS_PER_PARTITION = 250_000


def skip_reservoir(batches: Iterator[pd.DataFrame], size: int, rng: np.random.Generator) -> tuple[pd.DataFrame | None, int]:
    """``(reservoir, records seen)``; rows between two accepted records are passed over in one step."""
    held: pd.DataFrame | None = None
    seen, w, upcoming = 0, 1.0, -1

    def advance(at: int) -> int:
        nonlocal w
        w *= math.exp(math.log(1.0 - rng.random()) / size)
        gap = math.log(1.0 - rng.random()) / math.log1p(-w) if w < 1.0 else 0.0
        return at + int(min(gap, 2**62)) + 1

    for batch in batches:
        first = seen
        seen += len(batch)
        if held is None or len(held) < size:
            room = size - (0 if held is None else len(held))
            part = batch.iloc[:room]
            held = part.copy() if held is None else pd.concat([held, part], ignore_index=True)
            if len(held) == size and upcoming < 0:
                upcoming = advance(first + len(part) - 1)
        taken: dict[int, int] = {}
        while 0 <= upcoming < seen:
            taken[int(rng.integers(size))] = upcoming - first
            upcoming = advance(upcoming)
        if taken:
            slots, rows = list(taken), batch.iloc[list(taken.values())]
            kept = held.drop(index=slots)
            held = pd.concat([kept, rows.set_axis(slots)]).sort_index()
    return held, seen


def hypergeometric_merge(parts: list[tuple[pd.DataFrame, int]], size: int, rng: np.random.Generator) -> tuple[pd.DataFrame, int]:
    """One reservoir of the union of the populations that ``parts`` stand for."""
    total = sum(n for _, n in parts)
    want, left, out = min(size, total), total, []
    need = want
    for rows, population in parts:
        # Of ``need`` records drawn from ``left``, how many fall to this part (numpy takes up to 1e9 a side).
        k = big_hypergeometric(rng, population, left - population, need)
        out.append(rows.iloc[rng.choice(len(rows), k, replace=False)] if k else rows.iloc[:0])
        need, left = need - k, left - population
    return pd.concat(out, ignore_index=True), total


def big_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    hits = 0  # draws is the sample size, so one step a drawn record is cheap
    for _ in range(draws):
        if rng.random() * (good + bad) < good:
            hits, good = hits + 1, good - 1
        else:
            bad -= 1
    return hits


def reservoir_sample(df: DataFrame, record: str, size: int, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """``size`` rows of ``df`` (all, if there are fewer), each with equal chance, and ``n_population``.

    Each ``record`` must be there once. Rows are spread by the hash of ``record`` and ordered by it within a
    partition, so the same data give the same sample wherever tasks run or are repeated. Without ``partitions``
    their number follows from that of the rows. No task holds more than FAN_IN reservoirs. An empty table gives no
    rows. ``df`` must not have columns ``_part``, ``_seen``. Pass ids alone and fetch the rest by
    ``rows_of_sample``, so that only ids are moved.
    """
    if size < 1:
        raise ValueError("size must be positive")
    if partitions is None:
        partitions = max(1, -(-df.count() // ROWS_PER_PARTITION))
    spread = df.repartition(partitions, F.xxhash64(record)).sortWithinPartitions(record)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_seen", T.LongType())])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        held, seen = skip_reservoir(batches, size, np.random.default_rng([seed, part]))
        if held is not None and seen:
            yield held.assign(_part=part, _seen=seen)

    def merge(level: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["_part", record], kind="stable")
            parts = [(rows.drop(columns=["_part", "_seen"]), int(rows["_seen"].iloc[0])) for _, rows in group.groupby("_part")]
            target = int(group["_part"].iloc[0]) // FAN_IN
            rows, total = hypergeometric_merge(parts, size, np.random.default_rng([seed, level, target]))
            return rows.assign(_part=target, _seen=total)[list(group.columns)]

        return run

    held = spread.mapInPandas(draw, schema)
    for level in range(1, 1 + math.ceil(math.log(partitions, FAN_IN) - 1e-9)):
        held = held.groupBy((F.col("_part") / FAN_IN).cast("int").alias("_to")).applyInPandas(merge(level), schema)
    return held.drop("_part").withColumnRenamed("_seen", "n_population")


def sample_records(df: DataFrame, record: str, size: int, seed: int = 17) -> DataFrame:
    """``record, n_population`` of ``size`` records drawn from the distinct ids of ``df``: deliveries of one id are one record.

    A null id identifies no record.
    """
    return reservoir_sample(df.where(F.col(record).isNotNull()).select(record).distinct(), record, size, seed)


def rows_of_sample(df: DataFrame, record: str, sample: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``record`` was drawn, with ``n_population``. The sample's size is a parameter, so it is broadcast."""
    return df.join(F.broadcast(sample), record)
