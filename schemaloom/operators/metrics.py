"""Agreement of clusterings and of raters, all from one contingency table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2.0


def cluster_scores(table: DataFrame) -> DataFrame:
    """One row: adjusted Rand index, NMI (arithmetic mean), B-cubed, purity and inverse purity of ``gold, pred, n``."""
    g = table.groupBy("gold").agg(F.sum("n").alias("gn"))
    p = table.groupBy("pred").agg(F.sum("n").alias("pn"))
    both = table.join(g, "gold").join(p, "pred")
    total = table.agg(F.sum("n")).scalar()
    cell = both.agg(
        F.sum(pairs_of(F.col("n"))).alias("s"),
        F.sum(F.col("n") / total * F.log(F.col("n") * total / (F.col("gn") * F.col("pn")))).alias("mi"),
        F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("gn")).alias("br"), F.sum("n").cast("double").alias("t"))
    entropy = lambda c: -F.sum(F.col(c) / total * F.log(F.col(c) / total))
    gold = g.agg(F.sum(pairs_of(F.col("gn"))).alias("sg"), entropy("gn").alias("hg"))
    pred = p.agg(F.sum(pairs_of(F.col("pn"))).alias("sp"), entropy("pn").alias("hp"))
    purity = table.groupBy("pred").agg(F.max("n").alias("n")).agg(F.sum("n").alias("pu"))
    inverse = table.groupBy("gold").agg(F.max("n").alias("n")).agg(F.sum("n").alias("ip"))
    row = cell
    for one in (gold, pred, purity, inverse):  # rows of one number each
        row = row.withColumn("_k", F.lit(1)).join(one.withColumn("_k", F.lit(1)), "_k").drop("_k")
    expected = F.col("sg") * F.col("sp") / pairs_of(F.col("t"))
    precision, recall = F.col("bp") / F.col("t"), F.col("br") / F.col("t")
    rounded = {
        "ari": F.try_divide(F.col("s") - expected, (F.col("sg") + F.col("sp")) / 2 - expected),
        "nmi": F.try_divide(F.col("mi"), (F.col("hg") + F.col("hp")) / 2),
        "b3_precision": precision, "b3_recall": recall, "b3_f": 2 * precision * recall / (precision + recall),
        "purity": F.col("pu") / F.col("t"), "inverse_purity": F.col("ip") / F.col("t"),
    }
    return row.select(*(F.round(v, 6).alias(k) for k, v in rounded.items()))


def best_assignment(profit: np.ndarray) -> np.ndarray:
    """For each row of a square matrix the column of the assignment with the greatest sum (shortest augmenting paths)."""
    n = len(profit)
    cost = profit.max() - profit
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        low, way, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            done[col] = True
            free = ~done[1:]
            reduced = cost[match[col] - 1] - u[match[col]] - v[1:]
            better = free & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], col
            nxt = 1 + int(np.argmin(np.where(free, low[1:], np.inf)))
            delta = low[nxt]
            u[match[done]] += delta
            v[done] -= delta
            low[1:][free] -= delta
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col], col = match[way[col]], way[col]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


MOST_LABELS = 500


def accuracy(table: DataFrame) -> float:
    """Share of rows that agree under the best one-to-one map of labels; at most MOST_LABELS labels a side."""
    rows = table.limit(MOST_LABELS**2 + 1).collect()
    golds, preds = (sorted({r[c] for r in rows}, key=repr) for c in ("gold", "pred"))
    size = max(len(golds), len(preds))
    if size > MOST_LABELS:
        raise ValueError("too many labels for an assignment")
    m = np.zeros((size, size))
    for r in rows:
        m[golds.index(r["gold"]), preds.index(r["pred"])] = r["n"]
    return float(m[np.arange(size), best_assignment(m)].sum() / m.sum()) if m.sum() else float("nan")


def rater_agreement(votes: DataFrame) -> DataFrame:
    """One row of agreement over ``item, vote`` (a row a rater and item, the same number of raters each).

    Percentage agreement, Fleiss' and Randolph's kappa, Krippendorff's alpha for nominal data. Items with a
    single vote can't agree and stay out.
    """
    per = votes.where("item is not null and vote is not null").groupBy("item", "vote").agg(F.count(F.lit(1)).alias("n"))
    item = per.groupBy("item").agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("r > 1")
    kept = per.join(item.select("item"), "item", "left_semi")
    total = kept.agg(F.sum("n")).scalar()
    marginal = kept.groupBy("vote").agg(F.sum("n").alias("m"))
    chance = marginal.agg(F.sum(F.pow(F.col("m") / total, 2.0)).alias("pe"), F.sum(F.col("m") * (F.col("m") - 1)).alias("mm"), F.count(F.lit(1)).alias("k"))
    seen = item.agg(F.avg(F.col("same") / (F.col("r") * (F.col("r") - 1))).alias("po"), F.sum(F.col("same") / (F.col("r") - 1)).alias("co"), F.sum("r").alias("t"))
    row = seen.withColumn("_k", F.lit(1)).join(chance.withColumn("_k", F.lit(1)), "_k")
    t = F.col("t")
    return row.select(
        F.round("po", 6).alias("agreement"),
        F.round(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), 6).alias("fleiss_kappa"),
        F.round(F.try_divide(F.col("po") - 1 / F.col("k"), 1 - 1 / F.col("k")), 6).alias("randolph_kappa"),
        F.round(1 - F.try_divide((t - F.col("co")) * (t - 1), t * t - t - F.col("mm")), 6).alias("krippendorff_alpha"),
    )


def majority(votes: DataFrame) -> DataFrame:
    """``item, vote, n, n_votes, unanimous``: the most frequent vote of each item (of equals the smallest)."""
    per = votes.groupBy("item", "vote").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("item").agg(F.min(F.struct((-F.col("n")).alias("m"), "vote")).alias("x"), F.sum("n").alias("n_votes"))
    return best.select("item", "x.vote", (-F.col("x.m")).alias("n"), "n_votes", (-F.col("x.m") == F.col("n_votes")).alias("unanimous"))
