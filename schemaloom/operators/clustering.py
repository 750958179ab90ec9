"""Clusterings of vectors by name, fuzzy clustering of graphs, and the table that compares them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.operators import graph, metrics, vectors
from schemaloom.session import with_checkpoints

# Rows that clusterings of all pairs take in one task: they hold a matrix of that size squared.
MOST_PAIRED = 5000


def in_one_task(df: DataFrame, item: str, vector: str, label: Callable[[np.ndarray], np.ndarray], most: int = MOST_PAIRED) -> DataFrame:
    """``item, cluster`` by a function of all vectors together, for methods that need all pairs; more than ``most`` rows are refused."""
    kind = dict(df.dtypes)[item]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > most:
            raise ValueError(f"this clustering holds all pairs: at most {most} rows")
        part = part.sort_values(item)
        return pd.DataFrame({item: part[item], "cluster": label(np.array(part[vector].tolist(), np.float64)).astype(np.int32)})

    return df.select(item, vector).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, f"{item} {kind}, cluster int")


def centred_means(x: np.ndarray, k: int, seed: int = 1234, rounds: int = 100) -> np.ndarray:
    """Labels of k-means with k-means++ starts."""
    rng = np.random.default_rng(seed)
    centre = [x[rng.integers(len(x))]]
    for _ in range(1, min(k, len(x))):
        away = np.min([((x - c) ** 2).sum(1) for c in centre], axis=0)
        centre.append(x[rng.choice(len(x), p=away / away.sum())] if away.sum() > 0 else x[0])
    c = np.array(centre)
    for _ in range(rounds):
        label = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return label


def spectral_labels(similarity: np.ndarray, k: int, seed: int = 1234) -> np.ndarray:
    """Spectral clustering of a similarity matrix: k-means on the leading vectors of the normalised matrix."""
    s = np.maximum(similarity, 0.0)
    scale = 1 / np.sqrt(np.maximum(s.sum(1), 1e-12))
    _, vector = np.linalg.eigh(scale[:, None] * s * scale[None, :])
    lead = vector[:, -k:] * scale[:, None]
    return centred_means(lead, k, seed)


def cosines(x: np.ndarray) -> np.ndarray:
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return unit @ unit.T


def density_labels(x: np.ndarray, radius: float = 0.5, least: int = 5) -> np.ndarray:
    """DBSCAN by Euclidean distance; -1 is noise. A border point joins the cluster that reaches it first."""
    square = (x**2).sum(1)
    near = square[:, None] + square[None, :] - 2 * x @ x.T <= radius**2 + 1e-12
    core, label, cluster = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        label[i], todo = cluster, [i]
        while todo:
            reached = np.flatnonzero(near[todo.pop()] & (label < 0))
            label[reached] = cluster
            todo += reached[core[reached]].tolist()
        cluster += 1
    return label


def neighbour_graph(df: DataFrame, item: str, vector: str, k: int) -> DataFrame:
    """``a, b, w``: each row with its ``k`` nearest by cosine, each pair once; similarities below 0 go."""
    near = vectors.nearest(df, item, vector, df, k)
    rows = near.select(F.least("query", "item").cast("string").alias("a"), F.greatest("query", "item").cast("string").alias("b"), F.col("similarity").alias("w"))
    return rows.where("w > 0").groupBy("a", "b").agg(F.max("w").alias("w"))


def whispered(df: DataFrame, item: str, vector: str, k: int) -> DataFrame:
    """``item, cluster``: label propagation on the graph of ``k`` nearest neighbours."""
    kind = dict(df.dtypes)[item]
    found = graph.chinese_whispers(neighbour_graph(df, item, vector, k))
    return found.select(F.col("node").cast(kind).alias(item), F.col("label").alias("cluster"))


def triple_vectors(triples: DataFrame, places: list[str], tables: list[DataFrame]) -> DataFrame:
    """``triples`` with ``vector``: the vectors of its words one after the other, each of unit length. Every place has its table of
    ``word, vector`` (they may be the same); triples with a word without one go."""
    rows = triples
    for i, (place, table) in enumerate(zip(places, tables, strict=True)):
        rows = rows.join(table.select(F.col("word").alias(place), F.col("vector").alias(f"_v{i}")), place)
    own = vectors.concatenated(*(F.col(f"_v{i}") for i in range(len(places))))
    return rows.withColumn("vector", own).select(*triples.columns, "vector")


def whispered_frames(triples: DataFrame, places: list[str], tables: list[DataFrame], k: int = 10) -> DataFrame:
    """``triples`` with ``cluster``: label propagation on the graph of the ``k`` nearest triples."""
    rows = triple_vectors(triples, places, tables).withColumn("_name", F.concat_ws("|", *places))
    found = whispered(rows.select("_name", "vector").dropDuplicates(["_name"]), "_name", "vector", k)
    return rows.join(found, "_name").select(*triples.columns, "cluster")


# Clusterings by name: functions of (table, item, vector, k) to ``item, cluster``.
METHODS: dict[str, Callable[[DataFrame, str, str, int], DataFrame]] = {
    "kmeans": vectors.k_means,
    "agglomerative": lambda df, item, vector, k: in_one_task(df, item, vector, lambda x: vectors.ward(x, min(k, len(x)))),
    "spectral": lambda df, item, vector, k: in_one_task(df, item, vector, lambda x: spectral_labels(cosines(x), min(k, len(x)))),
    "density": lambda df, item, vector, k: in_one_task(df, item, vector, density_labels),
    "whispers": whispered,
}


def comparison(df: DataFrame, item: str, vector: str, gold: str, k: int, methods: tuple[str, ...]) -> DataFrame:
    """``method, n_clusters, ari, nmi, b3_f``: a row a method of METHODS against ``gold``."""
    rows = None
    for name in methods:
        found = METHODS[name](df.select(item, vector), item, vector, k).withColumn("cluster", F.col("cluster").cast("string"))
        table = metrics.contingency(found.join(df.select(item, gold), item), gold, "cluster")
        one = metrics.cluster_scores(table).withColumn("_k", F.lit(1)).join(table.agg(F.count_distinct("pred").alias("n_clusters")).withColumn("_k", F.lit(1)), "_k")
        one = one.select(F.lit(name).alias("method"), "n_clusters", "ari", "nmi", "b3_f")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def over_repeats(scores: DataFrame, method: str, columns: list[str]) -> DataFrame:
    """``method`` and, of each score, mean and population deviation over repeated runs."""
    each = [x for c in columns for x in (F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{c}_std"))]
    return scores.groupBy(method).agg(*each, F.count(F.lit(1)).alias("n_runs"))


def same_cluster(label: np.ndarray) -> np.ndarray:
    return label[:, None] == label[None, :]


def joint_objective(labels: tuple[np.ndarray, np.ndarray], similarity: tuple[np.ndarray, np.ndarray]) -> float:
    """Similarity between clusters plus dissimilarity within them, of both sides; each pair counts once."""
    total = 0.0
    for label, s in zip(labels, similarity):
        same = same_cluster(label)
        total += np.diagonal(s).sum() / 2 + s[~same].sum() / 2 + (1 - s)[same].sum() / 2
    return float(total)


def shared_clusters(edges: np.ndarray, side: int, n: int, other: np.ndarray, k: int) -> np.ndarray:
    """ln(1 + Jaccard) of the clusters of the other side that two nodes of this side are linked to."""
    linked = np.zeros((n, k), bool)
    linked[edges[:, side], other[edges[:, 1 - side]]] = True
    met = linked.astype(float) @ linked.T
    size = linked.sum(1)
    either = size[:, None] + size[None, :] - met
    return np.log1p(np.divide(met, either, out=np.zeros_like(met), where=either > 0))


def joint_clusters(left: np.ndarray, right: np.ndarray, edges: np.ndarray, left_k: range, right_k: range, rounds: int = 10) -> tuple[float, np.ndarray, np.ndarray]:
    """Spectral clustering of both sides of a bipartite graph, each under the other's clusters in turn; over all numbers of
    clusters and rounds that with the smallest objective: ``(objective, labels, labels)``. For a few thousand nodes."""
    near = cosines(left), cosines(right)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for kl in left_k:
        for kr in right_k:
            a, b = spectral_labels(near[0], kl), spectral_labels(near[1], kr)
            similarity = near
            for turn in range(rounds + 1):
                score = joint_objective((a, b), similarity)
                if best is None or score < best[0]:
                    best = score, a, b
                if turn < rounds:
                    one = near[0] + shared_clusters(edges, 0, len(left), b, kr)
                    a = spectral_labels(one, kl)
                    two = near[1] + shared_clusters(edges, 1, len(right), a, kl)
                    b = spectral_labels(two, kr)
                    similarity = one, two
    return best


def local_whispers(nodes: list, edges: dict, rounds: int = 20) -> dict:
    """Label propagation on one small graph; nodes in order, ties to the smallest label."""
    label = {x: x for x in nodes}
    around: dict = {x: [] for x in nodes}
    for (a, b), w in edges.items():
        around[a].append((b, w))
        around[b].append((a, w))
    for _ in range(rounds):
        moved = False
        for x in nodes:
            votes: dict = {}
            for y, w in around[x]:
                votes[label[y]] = votes.get(label[y], 0.0) + w
            if votes and (new := min(votes, key=lambda c: (-votes[c], c))) != label[x]:
                label[x], moved = new, True
        if not moved:
            break
    return label


def sense_contexts(edges: DataFrame) -> DataFrame:
    """``node, sense, neighbour, w``: the neighbours of each node in groups, found in the graph among them without the node.

    ``edges`` is ``a, b, w``, each pair once. A node's own neighbourhood comes to one task, as in a graph of nearest
    neighbours.
    """
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    left, right = both.select(F.col("a").alias("node"), F.col("b").alias("x")), both.select(F.col("a").alias("node"), F.col("b").alias("y"))
    inside = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").join(left, "x").join(right, ["node", "y"]).select("node", "x", "y", "w")
    rows = inside.unionByName(both.select(F.col("a").alias("node"), F.col("b").alias("x"), F.lit(None).cast("string").alias("y"), "w"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part["y"].isna()].sort_values("x")
        links = part[part["y"].notna()]
        label = local_whispers(own["x"].tolist(), dict(zip(zip(links["x"], links["y"]), links["w"])))
        number = {c: i for i, c in enumerate(sorted(set(label.values())))}
        return pd.DataFrame({"node": part["node"].iloc[0], "sense": [number[label[x]] for x in own["x"]], "neighbour": own["x"], "w": own["w"]})

    return rows.groupBy("node").applyInPandas(run, "node string, sense int, neighbour string, w double")


def fuzzy_clusters(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``cluster, node``: clusters of a graph in which a node with several senses is in several (after the published Watset scheme).

    Each sense's neighbours are given the sense of their own whose context is most like the sense's; the graph of senses
    is then clustered by label propagation. ``edges`` is ``a, b, w``, each pair once.
    """
    with_checkpoints(edges.sparkSession)
    contexts = sense_contexts(edges).checkpoint()
    own = contexts.select("node", "sense").distinct().select("node", "sense", F.col("node").alias("neighbour"), F.lit(1.0).alias("w"))
    full = contexts.unionByName(own)
    norms = full.groupBy("node", "sense").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    one = full.select(F.col("node").alias("u"), F.col("sense").alias("i"), F.col("neighbour").alias("x"), F.col("w").alias("wu"))
    two = full.select(F.col("node").alias("v"), F.col("sense").alias("j"), F.col("neighbour").alias("x"), F.col("w").alias("wv"))
    wanted = contexts.select(F.col("node").alias("u"), F.col("sense").alias("i"), F.col("neighbour").alias("v"), "w")
    shared = wanted.join(one, ["u", "i"]).join(two, ["v", "x"]).groupBy("u", "i", "v", "w", "j").agg(F.sum(F.col("wu") * F.col("wv")).alias("dot"))
    scored = shared.join(norms.select(F.col("node").alias("v"), F.col("sense").alias("j"), "norm"), ["v", "j"])
    best = scored.groupBy("u", "i", "v", "w").agg(F.min(F.struct((-F.round(F.col("dot") / F.col("norm"), 9)).alias("s"), "j")).alias("x"))
    name = lambda n, s: F.concat_ws("#", n, s.cast("string"))
    senses = best.select(name(F.col("u"), F.col("i")).alias("p"), name(F.col("v"), F.col("x.j")).alias("q"), "w")
    graph_of = senses.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "w").groupBy("a", "b").agg(F.max("w").alias("w"))
    found = graph.chinese_whispers(graph_of, rounds)
    return found.select(F.col("label").alias("cluster"), F.regexp_replace("node", "#[^#]*$", "").alias("node")).distinct()


def reduced(df: DataFrame, item: str, vector: str, k: int) -> DataFrame:
    """``item, vector``: rows projected on the ``k`` leading right singular vectors of all of them, each of unit length.

    The rows' products are summed in the tasks, so what meets on the driver is one matrix of the vectors' dimension
    squared. Signs are fixed by the largest coordinate. Null vectors go.
    """
    rows = df.select(item, F.transform(vector, lambda x: x.cast("double")).alias("_v")).where("_v is not null")

    def products(batches):
        total = None
        for part in batches:
            x = np.array(part["_v"].tolist())
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"m": [total.ravel().tolist()]})

    parts = rows.select("_v").mapInPandas(products, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    size = int(np.sqrt(len(parts)))
    m = np.zeros(len(parts))
    for r in parts:
        m[r["i"]] = r["x"]
    axes = np.linalg.eigh(m.reshape(size, size))[1][:, ::-1][:, :k] if size else np.zeros((0, k))
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0) if size else axes

    def project(batches):
        for part in batches:
            y = np.array(part["_v"].tolist()) @ axes
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({item: part[item], "vector": y.tolist()})

    return rows.mapInPandas(project, T.StructType([df.schema[item], T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def hashed_vectors(weights: DataFrame, item: str, word: str, value: str, width: int = 256) -> DataFrame:
    """``item, vector``: words' values at ``width`` places by hash, signs by another bit of it, so that clashes cancel on average."""
    h = F.xxhash64(word)
    cell = weights.select(item, F.pmod(h, F.lit(width)).cast("int").alias("place"), F.when(F.shiftrightunsigned(h, 40) % 2 == 0, F.col(value)).otherwise(-F.col(value)).alias("x"))
    summed = cell.groupBy(item, "place").agg(F.sum("x").alias("x"))
    as_map = summed.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("_m"))  # at most ``width`` places
    return as_map.select(item, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("vector"))
