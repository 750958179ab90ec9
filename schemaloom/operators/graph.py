"""Graph steps of schema induction: many small graphs side by side, or one graph of bounded size."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.operators.ranking import ranked
from schemaloom.session import with_checkpoints

DAMPING, STEPS, EPSILON = 0.8, 300, 1e-6


def page_rank(weights: np.ndarray, damping: float = DAMPING, steps: int = STEPS, epsilon: float = EPSILON) -> np.ndarray:
    """Power iteration on the column-normalised matrix; nodes without links lose their mass."""
    n = len(weights)
    total = weights.sum(axis=0)
    move = np.divide(weights, total, out=np.zeros_like(weights, dtype=float), where=total > 0)
    rank = np.full(n, 1.0 / n)
    for _ in range(steps):
        new = damping * move @ rank + (1 - damping) / n
        if np.linalg.norm(rank - new) < epsilon:
            return new
        rank = new
    return rank


def sparse_page_rank(n: int, to: np.ndarray, start: np.ndarray, weight: np.ndarray, damping: float = DAMPING, steps: int = STEPS, epsilon: float = EPSILON) -> np.ndarray:
    """``page_rank`` of the matrix with ``weight`` at (``to``, ``start``)."""
    total = np.bincount(start, weight, n)
    move = np.divide(weight, total[start], out=np.zeros_like(weight, dtype=float), where=total[start] > 0)
    rank = np.full(n, 1.0 / n)
    for _ in range(steps):
        new = damping * np.bincount(to, move * rank[start], n) + (1 - damping) / n
        if np.linalg.norm(rank - new) < epsilon:
            return new
        rank = new
    return rank


def group_page_rank(edges: DataFrame, group: str) -> DataFrame:
    """``group, node, rank`` of undirected weighted edges ``group, a, b, w``: one graph a group.

    A group's edges come to one task, which holds them as a sparse matrix; links of a pair met twice add up.
    """
    kind = dict(edges.dtypes)[group]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([part["a"], part["b"]]).astype(str))
        a, b, w = np.searchsorted(nodes, part["a"].astype(str)), np.searchsorted(nodes, part["b"].astype(str)), part["w"].to_numpy(float)
        rank = sparse_page_rank(len(nodes), np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]))
        return pd.DataFrame({group: part[group].iloc[0], "node": nodes, "rank": rank})

    return edges.select(group, "a", "b", "w").groupBy(group).applyInPandas(run, f"{group} {kind}, node string, rank double")


def louvain(nodes: list, edges: dict[tuple, float], n_edges: float | None = None) -> dict:
    """Community of each node; nodes are visited in the given order until none moves, then communities merge.

    The gain of joining a community is the weight towards it less degree times its degree over ``n_edges``,
    which is the number of edges of the complete graph: pairs without weight count as edges of weight zero. A
    node moves to the community of greatest gain above 0; of equals that with the node that comes first, its own
    only if that is it. Merged, the weights inside a community count once towards its degree, and communities
    are visited as their links are met.
    """
    members = {i: [x] for i, x in enumerate(nodes)}
    at = {x: i for i, x in enumerate(nodes)}
    links: dict[int, dict[int, float]] = defaultdict(dict)
    for (a, b), w in edges.items():
        i, j = at[a], at[b]
        if w and i != j:
            links[i][j] = links[i].get(j, 0.0) + w
            links[j][i] = links[j].get(i, 0.0) + w
    m = n_edges if n_edges is not None else len(nodes) * (len(nodes) - 1) / 2
    inner = dict.fromkeys(members, 0.0)
    order, first_level = sorted(members), True
    while m:
        home = {i: i for i in members}
        inside = {i: {i} for i in members}
        degree = {i: sum(links[i].values()) + inner[i] for i in members}
        total = dict(degree)
        moved = True
        any_move = False
        while moved:
            moved = False
            for i in order:
                toward: dict[int, float] = {}
                for j, w in links[i].items():
                    toward[home[j]] = toward.get(home[j], 0.0) + w
                own = home[i]
                if first_level and len(inside[own]) > 1:
                    toward.setdefault(own, 0.0)  # in the complete graph all members are neighbours
                if not toward:
                    continue
                gains = {c: w - degree[i] * (total[c] - (degree[i] if c == own else 0.0)) / m for c, w in toward.items()}
                top = max(gains.values())
                if top <= 0:
                    continue
                met = lambda c: min((x for x in inside[c] if x != i and (first_level or x in links[i])), default=len(nodes))  # noqa: B023, E731
                best = min((c for c, g in gains.items() if g == top), key=met)
                if best != own:
                    inside[own].discard(i)
                    inside[best].add(i)
                    total[own] -= degree[i]
                    total[best] += degree[i]
                    home[i], moved, any_move = best, True, True
        if not any_move:
            break
        merged: dict[int, list] = defaultdict(list)
        new_links: dict[int, dict[int, float]] = defaultdict(dict)
        new_inner: dict[int, float] = defaultdict(float)
        for i in sorted(members):
            merged[home[i]] += members[i]
            new_inner[home[i]] += inner[i]
            for j, w in links[i].items():
                a, b = home[i], home[j]
                if a == b:
                    new_inner[a] += w / 2  # met from both ends
                else:
                    new_links[a][b] = new_links[a].get(b, 0.0) + w
        members, links, inner = dict(merged), new_links, new_inner
        seen: dict[int, None] = {}
        for a in sorted(links):
            for b in sorted(links[a]):
                if b > a:
                    seen.setdefault(a), seen.setdefault(b)
        order, first_level = list(seen), False
    place = {x: i for i, x in enumerate(nodes)}
    groups = sorted((sorted(g, key=place.get) for g in members.values()), key=lambda g: (-len(g), place[g[0]]))
    return {x: c for c, group in enumerate(groups) for x in group}


# Nodes up to which a graph goes to one task as it is; a larger one is parted into its components first.
ONE_TASK = 20_000


def communities(nodes: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node, community`` of ``nodes`` (``node, position``) and ``edges`` (``a, b, w``); the largest community is 0.

    Communities never leave a component, and the number of edges of the complete graph is known, so a graph of
    more than ``one_task`` nodes is done component by component, with the same result.
    """
    rows = nodes.select(F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.col("position").cast("double").alias("w")).unionByName(edges.select("a", "b", F.col("w").cast("double").alias("w")))
    count = nodes.count()
    all_pairs = count * (count - 1) / 2

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part["b"].isna()].sort_values(["w", "a"])
        pairs = part[part["b"].notna()].sort_values(["a", "b"])
        found = louvain(own["a"].tolist(), {(a, b): w for a, b, w in zip(pairs["a"], pairs["b"], pairs["w"])}, all_pairs)
        return pd.DataFrame({"node": own["a"], "position": own["w"], "community": own["a"].map(found).astype("int32")})

    kind = "node string, position double, community int"
    if count <= one_task:
        return rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, kind).drop("position")
    home = components(edges)
    parted = rows.join(home.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    found = parted.groupBy("component").applyInPandas(lambda part: run(part).assign(component=part["component"].iloc[0]), f"{kind}, component string")
    found = found.checkpoint()
    sizes = found.groupBy("component", "community").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("position", "node")).alias("first"))
    numbered = ranked(sizes, [], [F.desc("n"), F.col("first")]).select("component", "community", (F.col("rank") - 1).cast("int").alias("_number"))
    return found.join(numbered, ["component", "community"]).select("node", F.col("_number").alias("community"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of an undirected graph of any size: the smallest node of each component.

    Alternates linking every neighbour to the smallest one seen and short-cutting through it, so the number of
    rounds grows with the logarithm of a component's diameter; it ends when nothing changes. Lineage is cut by
    checkpoint each round.
    """
    with_checkpoints(edges.sparkSession)
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null").distinct().checkpoint()
    while True:
        both = pairs.where("u <> v").unionByName(pairs.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = large.unionByName(pairs.where("u = v")).distinct()
        low = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = small.unionByName(low.select(F.col("m").alias("u"), F.col("m").alias("v"))).distinct().checkpoint()
        same = new.exceptAll(pairs).isEmpty() and pairs.exceptAll(new).isEmpty()
        pairs = new
        if same:
            break
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def chinese_whispers(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``node, label`` by label propagation: a node takes the label of most weight around it (smallest of equals).

    In each of ``rounds`` a half of the nodes, drawn by hash, moves, so that neighbours don't swap labels for ever; it
    ends when no node wants to move.
    """
    with_checkpoints(edges.sparkSession)
    edges = edges.select("a", "b", "w").checkpoint()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for turn in range(rounds):
        votes = both.join(labels, both["b"] == labels["node"]).groupBy("a", "label").agg(F.sum("w").alias("w"))
        wanted = votes.groupBy(F.col("a").alias("node")).agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("x")).select("node", F.col("x.label").alias("_wanted"))
        moves = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        new = labels.join(wanted, "node").select("node", F.when(moves, F.col("_wanted")).otherwise(F.col("label")).alias("label"), (F.col("label") != F.col("_wanted")).alias("_open")).checkpoint()
        still = new.where("_open").isEmpty()
        labels = new.select("node", "label")
        if still:
            break
    return labels


def shortest_paths(edges: DataFrame, source: str, most: int | None = None) -> DataFrame:
    """``node, hops`` of all nodes reached from one node along directed edges ``a, b``, by frontier; ``most`` bounds the hops if given."""
    with_checkpoints(edges.sparkSession)
    edges = edges.select("a", "b").distinct().checkpoint()
    reached = edges.sparkSession.createDataFrame([(source, 0)], "node string, hops int")
    frontier, hop = reached, 0
    while most is None or hop < most:
        hop += 1
        step = frontier.join(edges, frontier["node"] == edges["a"]).select(F.col("b").alias("node")).distinct().join(reached, "node", "left_anti")
        frontier = step.withColumn("hops", F.lit(hop)).checkpoint()
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if hop % 8 == 0:  # one table again: else every hop adds a part to the plan
            reached = reached.checkpoint()
    return reached


def path_between(links: dict[str, list[str]], source: str, target: str) -> list[str] | None:
    """A shortest path along ``links`` (a node's next nodes in order); of equal ones that found first."""
    before, level = {source: None}, [source]
    while level and target not in before:
        following = []
        for x in level:
            for y in links.get(x, []):
                if y not in before:
                    before[y] = x
                    following.append(y)
        level = following
    if target not in before:
        return None
    path = [target]
    while before[path[-1]] is not None:
        path.append(before[path[-1]])
    return path[::-1]


def labelled_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``graph, a, b, words, deps, deps_n_words``: the labels along the shortest path of each pair, within graphs of a sentence's size.

    ``nodes`` are ``graph, node, label``, directed ``edges`` ``graph, a, b, label``, ``pairs`` ``graph, a, b``. Without a
    path from a to b the one from b to a counts; without either the labels are empty. Next nodes are tried in order of
    name; of several labels of a node or an edge the smallest counts, and a node without one stands by its name.
    """
    none = F.lit(None).cast("string")
    parts = [("n", nodes, (F.col("node"), none, F.col("label"))), ("e", edges, (F.col("a"), F.col("b"), F.col("label"))), ("p", pairs.distinct(), (F.col("a"), F.col("b"), none))]
    of = [df.select("graph", F.lit(k).alias("kind"), *(c.cast("string").alias(n) for c, n in zip(cols, ("a", "b", "label")))) for k, df, cols in parts]
    rows = of[0].unionByName(of[1]).unionByName(of[2])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(label=part["label"].fillna("")).sort_values(["a", "b", "label"], ascending=[True, True, False])
        word = {r.a: r.label for r in part[part["kind"] == "n"].itertuples() if r.label}
        arcs = {(r.a, r.b): r.label for r in part[(part["kind"] == "e") & part["a"].notna() & part["b"].notna()].itertuples()}
        links: dict[str, list[str]] = {}
        for a, b in arcs:
            links.setdefault(a, []).append(b)
        out = []
        for r in part[part["kind"] == "p"].itertuples():
            path = path_between(links, r.a, r.b) or path_between(links, r.b, r.a) or []
            steps = [(word.get(x, x), arcs[x, y], word.get(y, y)) for x, y in zip(path, path[1:])]
            out.append((r.graph, r.a, r.b, "-->".join(s for s, _, _ in steps), "-->".join(t for _, t, _ in steps), ":".join("--".join(s) for s in steps)))
        return pd.DataFrame(out, columns=["graph", "a", "b", "words", "deps", "deps_n_words"])

    graph = nodes.schema["graph"].dataType.simpleString()
    return rows.groupBy("graph").applyInPandas(run, f"graph {graph}, a string, b string, words string, deps string, deps_n_words string")
