import itertools

import numpy as np

from schemaloom.operators import clustering


def blobs(n=12, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.05, (n, 2)) for c in ((1, 0), (0, 1), (-1, 0))]), np.repeat([0, 1, 2], n)


def same_parts(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_methods_find_blobs(spark):
    x, gold = blobs()
    df = spark.createDataFrame([(i, v.tolist(), str(g)) for i, (v, g) in enumerate(zip(x, gold))], "i int, v array<double>, gold string")
    for name in ("kmeans", "agglomerative", "spectral", "density"):
        got = {r["i"]: r["cluster"] for r in clustering.METHODS[name](df, "i", "v", 3).collect()}
        assert same_parts([got[i] for i in range(len(x))], gold), name
    rows = {r["method"]: r for r in clustering.comparison(df, "i", "v", "gold", 3, ("agglomerative", "spectral")).collect()}
    assert rows["spectral"]["ari"] == 1.0 and rows["agglomerative"]["n_clusters"] == 3
    again = clustering.over_repeats(clustering.comparison(df, "i", "v", "gold", 3, ("spectral",)).unionByName(clustering.comparison(df, "i", "v", "gold", 3, ("spectral",))), "method", ["ari"]).first()
    assert again["ari_mean"] == 1.0 and again["ari_std"] == 0.0 and again["n_runs"] == 2


def test_density_against_definition():
    rng = np.random.default_rng(2)
    x = rng.random((60, 2))
    label = clustering.density_labels(x, 0.13, 4)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.13**2 + 1e-12
    core = near.sum(1) >= 4
    for i, j in itertools.combinations(range(60), 2):
        if core[i] and core[j] and near[i, j]:
            assert label[i] == label[j] >= 0
    assert all((label[i] >= 0) == bool((near[i] & core).any()) for i in range(60))


def test_joint_clusters_and_objective():
    x, gold = blobs(5)
    edges = np.array([(i, j) for i in range(15) for j in range(15) if gold[i] == gold[j]])
    score, a, b = clustering.joint_clusters(x, x, edges, range(2, 5), range(3, 4), 2)
    assert same_parts(b, gold) and np.isfinite(score)
    s = clustering.cosines(x)
    by_hand = sum(s[i, i] / 2 for i in range(15)) + sum((s[i, j] if gold[i] != gold[j] else 1 - s[i, j]) / 2 for i in range(15) for j in range(15))
    assert abs(clustering.joint_objective((gold, gold), (s, s)) - 2 * by_hand) < 1e-9


def test_a_node_of_two_senses_is_in_two_clusters(spark):
    left, right = list(itertools.combinations(["a", "b", "c", "m"], 2)), list(itertools.combinations(["x", "y", "z", "m"], 2))
    edges = spark.createDataFrame([(*sorted(p), 1.0) for p in left + right], "a string, b string, w double")
    groups = {}
    for r in clustering.fuzzy_clusters(edges).collect():
        groups.setdefault(r["cluster"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c", "m"], ["m", "x", "y", "z"]]


def test_reduction_equals_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6)) * [5, 3, 1, 0.5, 0.2, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>").repartition(3)
    got = {r["i"]: r["vector"] for r in clustering.reduced(df, "i", "v", 2).collect()}
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    y = x @ vt[:2].T
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert np.allclose(np.abs(np.array([got[i] for i in range(40)])), np.abs(y), atol=1e-6)
    hashed = clustering.hashed_vectors(spark.createDataFrame([("p", "w", 2.0), ("p", "v", 1.0)], "item string, word string, value double"), "item", "word", "value", 64).first()
    assert len(hashed["vector"]) == 64 and sorted(map(abs, (x for x in hashed["vector"] if x))) == [1.0, 2.0]


def test_empty(spark):
    none = spark.createDataFrame([], "i int, v array<double>")
    assert clustering.METHODS["spectral"](none, "i", "v", 3).count() == 0
    assert clustering.fuzzy_clusters(spark.createDataFrame([], "a string, b string, w double")).count() == 0


def test_chains_of_neighbours_merge_as_the_plain_way():
    from schemaloom.operators import vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    groups = [[i] for i in range(40)]
    while len(groups) > 6:
        cost = {(a, b): ((x[groups[a]].mean(0) - x[groups[b]].mean(0)) ** 2).sum() * len(groups[a]) * len(groups[b]) / (len(groups[a]) + len(groups[b])) for a, b in itertools.combinations(range(len(groups)), 2)}
        a, b = min(cost, key=cost.get)
        groups[a] += groups.pop(b)
    gold = np.zeros(40, int)
    for g, rows in enumerate(groups):
        gold[rows] = g
    assert same_parts(vectors.ward(x, 6), gold) and len(set(vectors.ward(x, 40))) == 40 and len(vectors.ward(x[:0], 3)) == 0
