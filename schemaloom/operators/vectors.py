"""Vector operators: cosine, means, exact nearest neighbours in blocks, rank-biased overlap, k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.operators.ranking import ranked

BLOCK, ROWS_A_BLOCK, LEAST_BLOCKS = 2048, 20_000, 3


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def mean_distance(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """``distance``: the mean cosine distance of two columns of vectors over all rows, by ``weight`` if given; rows without one go."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    gap = cosine_distance(F.col(a), F.col(b))
    return df.where(gap.isNotNull()).agg(F.round(F.try_divide(F.sum(gap * w), F.sum(w)), 6).alias("distance"))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, place, mean``: the mean vector of each key, one row a coordinate."""
    return df.select(key, F.posexplode(vector).alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def packed(means: DataFrame, key: str) -> DataFrame:
    """Coordinates gathered into one array a key; their number is the dimension."""
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda x: x["mean"]).alias("vector"))


def nearest(df: DataFrame, item: str, vector: str, queries: DataFrame, k: int = 10, blocks: int | None = None) -> DataFrame:
    """``query, item, rank, similarity``: the exact ``k`` nearest of all rows to each query, by cosine; itself not.

    Queries and rows are dealt into blocks; each pair of blocks is one matrix product in one task, which passes
    on only its ``k`` best a query. Neither side is broadcast or held whole. Ties go to the smaller id. Without
    ``blocks`` their number follows from that of the rows.
    """
    if blocks is None:
        blocks = LEAST_BLOCKS + df.count() // ROWS_A_BLOCK
    q = queries.select(F.col(item).alias("id"), F.col(vector).alias("v")).withColumn("side", F.lit(0))
    q = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = df.select(F.col(item).alias("id"), F.col(vector).alias("v")).withColumn("side", F.lit(1))
    r = r.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = dict(df.dtypes)[item]

    def product(part: pd.DataFrame) -> pd.DataFrame:
        both = [part[part["side"] == s].sort_values("id") for s in (0, 1)]
        if not len(both[0]) or not len(both[1]):
            return pd.DataFrame({"query": [], "item": [], "similarity": []})
        unit = []
        for side in both:
            m = np.array(side["v"].tolist(), np.float64)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            unit.append(np.divide(m, n, out=np.zeros_like(m), where=n > 0))
        ids, rows = both[0]["id"].to_numpy(), both[1]["id"].to_numpy()
        out = []
        for i in range(0, len(ids), BLOCK):
            s = np.round(unit[0][i : i + BLOCK] @ unit[1].T, 9)
            s[ids[i : i + BLOCK, None] == rows[None, :]] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query": np.repeat(ids[i : i + BLOCK], best.shape[1]), "item": rows[best].ravel(), "similarity": np.take_along_axis(s, best, 1).ravel()}))
        found = pd.concat(out)
        return found[np.isfinite(found["similarity"])]

    pairs = q.select("qb", "rb", "side", "id", "v").unionByName(r.select("qb", "rb", "side", "id", "v"))
    best = pairs.where("id is not null and v is not null").groupBy("qb", "rb").applyInPandas(product, f"query {kind}, item {kind}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "item")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def concatenated(*parts: Column) -> Column:
    """Vectors one after the other, each brought to unit length first; null if one is."""

    def unit(v: Column) -> Column:
        length = F.sqrt(dot(v, v))
        return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))

    return F.concat(*(unit(v) for v in parts))


def by_centre(df: DataFrame, item: str, vector: str, cluster: str) -> DataFrame:
    """``cluster, item, rank, distance``: the members of each cluster by their distance from its mean, the nearest first."""
    means = packed(mean_vectors(df, cluster, vector), cluster).withColumnRenamed("vector", "_mean")
    gap = F.zip_with(vector, "_mean", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    rows = df.join(means, cluster).withColumn("distance", F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)), 6))
    return ranked(rows.select(cluster, item, "distance"), [cluster], [F.col("distance"), F.col(item)]).select(cluster, item, "rank", "distance")


def rank_biased_overlap(a: Column, b: Column, depth: int) -> Column:
    """Mean agreement of the two lists' heads over depths 1 to ``depth`` (persistence 1)."""
    at = lambda n: F.size(F.array_intersect(F.slice(a, 1, n), F.slice(b, 1, n))) / n
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0.0), lambda s, n: s + at(n)) / depth


def reciprocal_rank_weights(df: DataFrame, key: str, terms: str) -> DataFrame:
    """``key, term, rank, weight``: the best rank of a term and the sum of 1 / ln(1 + rank) over a key's ranked lists; a term's first place in a list counts."""
    rows = df.withColumn("_list", F.monotonically_increasing_id()).select(key, "_list", F.posexplode(terms).alias("pos", "term"))
    first = rows.groupBy(key, "_list", "term").agg((F.min("pos") + 1).alias("rank"))
    return first.groupBy(key, "term").agg(F.min("rank").alias("rank"), F.sum(1 / F.log1p(F.col("rank"))).alias("weight"))


def k_means(df: DataFrame, item: str, vector: str, k: int, seed: int = 1234) -> DataFrame:
    """``item, cluster`` by Spark's distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(item, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select(item, F.col("prediction").alias("cluster"))


def ward(vectors: np.ndarray, k: int) -> np.ndarray:
    """Agglomerative clustering by Ward's criterion into ``k`` clusters, for a few thousand rows at most.

    Chains of nearest neighbours find the merges in any order; the cheapest n - k of them are those of the plain way.
    """
    n = len(vectors)
    if n > 5000:
        raise ValueError("Ward clustering holds all pairs: at most 5000 rows")
    if not n:
        return np.zeros(0, int)
    x = vectors.astype(float)
    sq = (x**2).sum(1)
    d = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0) / 2
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        i = chain[-1]
        j = int(np.argmin(d[i]))
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
            j = chain[-2]
            del chain[-2:]
            i, j = min(i, j), max(i, j)
            merges.append((d[i, j], i, j))
            s, a, b = size, size[i], size[j]
            merged = ((a + s) * d[i] + (b + s) * d[j] - s * d[i, j]) / (a + b + s)
            d[i], d[:, i] = merged, merged
            size[i], alive[j] = a + b, False
            d[i, i] = np.inf
            d[j], d[:, j] = np.inf, np.inf
            d[i, ~alive] = d[~alive, i] = np.inf
        else:
            chain.append(j)
    home = np.arange(n)

    def root(i: int) -> int:
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(n - k, 0)]:
        a, b = root(i), root(j)
        home[max(a, b)] = min(a, b)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]
