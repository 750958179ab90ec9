"""From completions to schemas: small cases, and communities against a plain version on complete graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from schemaloom.operators import graph, harvest, models, prompts


def plain_communities(n, weight):
    """Moves on the complete graph of n nodes with all pairs as edges, written without sparse shortcuts."""
    m = n * (n - 1) / 2
    links = {i: {j: weight.get((min(i, j), max(i, j)), 0.0) for j in range(n) if j != i} for i in range(n)}
    kin, nodes, members = dict.fromkeys(range(n), 0.0), {i: [i] for i in range(n)}, {i: {i} for i in range(n)}
    home, order = {i: i for i in range(n)}, list(range(n))
    while True:
        any_move, moved = False, True
        while moved:
            moved = False
            for v in order:
                degree = lambda x: sum(links.get(x, {}).values()) + kin[x]
                seen = {}
                for w in links[v]:
                    c = home[w]
                    if c not in seen:
                        total = sum(degree(x) for x in members[c]) - (degree(v) if c == home[v] else 0)
                        seen[c] = sum(x for k, x in links[v].items() if k in members[c]) - degree(v) * total / m
                c = max(seen, key=seen.get)
                if seen[c] > 0 and c != home[v]:
                    members[home[v]].discard(v)
                    members[c].add(v)
                    home[v], moved, any_move = c, True, True
        if not any_move:
            return sorted(sorted(x for v in c for x in nodes[v]) for c in members.values() if c)
        alive = {c: vs for c, vs in members.items() if vs}
        new_kin = {c: sum(kin[v] for v in vs) + sum(x / 2 for v in vs for k, x in links.get(v, {}).items() if k in vs) for c, vs in alive.items()}
        new_nodes = {c: [x for v in vs for x in nodes[v]] for c, vs in alive.items()}
        new_links = {}
        for a, b in itertools.combinations(sorted(alive), 2):
            w = sum(x for v in alive[a] for k, x in links.get(v, {}).items() if k in alive[b])
            if w:
                new_links.setdefault(a, {})[b] = w
                new_links.setdefault(b, {})[a] = w
        links, kin, nodes = new_links, new_kin, new_nodes
        members, home, order = {c: {c} for c in alive}, {c: c for c in alive}, list(new_links)


def test_communities_equal_the_plain_version():
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randint(2, 11)
        weight = {p: rng.choice([1.0, 3.0, 4.0, 0.5]) for p in itertools.combinations(range(n), 2) if rng.random() < rng.choice([0.15, 0.4, 0.8])}
        found = graph.louvain(list(range(n)), weight)
        groups = {}
        for x, c in found.items():
            groups.setdefault(c, []).append(x)
        assert sorted(sorted(g) for g in groups.values()) == plain_communities(n, weight)


def test_communities_component_by_component(spark):
    rng = random.Random(3)
    edges = [(f"n{a:02}", f"n{b:02}", float(rng.choice([1, 3]))) for a, b in itertools.combinations(range(24), 2) if a // 6 == b // 6 and rng.random() < 0.5]
    nodes = spark.createDataFrame([(f"n{i:02}", float(i)) for i in range(26)], "node string, position double")
    frame = spark.createDataFrame(edges, "a string, b string, w double")
    one, many = ({r["node"]: r["community"] for r in graph.communities(nodes, frame, limit).collect()} for limit in (1000, 1))
    assert one == many and len(one) == 26


def test_many_slots_are_kept(spark):
    raw = "v o & e " + " ".join(f"s{i:05}" for i in range(10_050))
    assert spark.range(1).select(F.size(prompts.parsed_completion(F.lit(raw))["slots"]).alias("n")).first()["n"] == 10_050


def test_a_long_chain_is_one_component(spark):
    edges = spark.range(3000).selectExpr("lpad(id, 5, '0') as a", "lpad(id + 1, 5, '0') as b", "1.0 as w")
    assert [r["component"] for r in graph.components(edges).select("component").distinct().collect()] == ["00000"]


def samples(spark):
    rows = [
        ("run race#0", "run", "race", 2.0, 0, "race/speed", ["driver", "car"]), ("run race#0", "run", "race", 2.0, 1, "runs", ["driver", "track"]), ("run race#0", "run", "race", 2.0, 2, "none", ["crowd"]),
        ("run firm#0", "run", "firm", 1.0, 0, "lead", ["boss"]), ("run firm#0", "run", "firm", 1.0, 1, "lead", ["boss"]), ("run firm#0", "run", "firm", 1.0, 2, "none", []),
        ("sell car#0", "sell", "car", 3.0, 0, "trade/sale", ["buyer", "price"]), ("sell car#0", "sell", "car", 3.0, 1, "sale", ["buyer"]), ("sell car#0", "sell", "car", 3.0, 2, "sale", ["dealer"]),
    ]
    return spark.createDataFrame(rows, "instance string, verb string, head string, salience double, sample int, event string, slots array<string>")


def test_completions_are_parsed_filtered_and_counted_off(spark):
    raw = spark.createDataFrame([(i, r) for i, r in enumerate(["run race & go a b a", "run race &", "run race & one", "run race & go x y", "odd & e s", "fly kite & go x y"])], "i int, raw string")
    rows = harvest.parsed_completions(raw)
    assert {r["i"]: (r["event"], r["slots"]) for r in rows.collect()} == {0: ("go", ["a", "b"]), 1: ("none", []), 2: ("none", []), 3: ("go", ["x", "y"]), 5: ("go", ["x", "y"])}
    terms = lambda *t: spark.createDataFrame([(x, 2.0) for x in t], "term string, salience double")
    kept = harvest.salient_completions(rows, terms("run"), terms("race"))
    assert kept.count() == 4 and kept.first()["salience"] == 4.0
    assert sorted((r["instance"], r["sample"]) for r in harvest.instances(kept, "i").collect()) == [("run race#0", 0), ("run race#0", 1), ("run race#0", 2)]


@pytest.mark.parametrize("event, verb, head, want", [
    ("race/speed", "run", "race", "race"), ("racer/speed", "run", "race", "racer-race"), ("runs", "run", "race", "runs"),
    ("xx/yy", "run", "race", "xx/yy"), ("races", "run", "race", "races-race"), ("one-run", "run", "race", "run"),
])
def test_event_names(spark, event, verb, head, want):
    got = spark.range(1).select(harvest.refined_event(F.lit(event), F.lit(verb), F.lit(head)).alias("x")).first()["x"]
    assert got["event"] == want


def test_scores_choice_and_edges(spark):
    rows = harvest.with_refined_events(samples(spark)).cache()
    scores = harvest.slot_scores(rows, ("tfidf", "rank", "sense")).cache()
    got = {(r["instance"], r["slot"]): r for r in scores.collect()}
    assert got["run firm#0", "boss"]["score"] is None and not got["run firm#0", "boss"]["kept"]  # one slot: no spread
    assert got["run race#0", "driver"]["kept"] and got["run race#0", "driver"]["rank"] > 0
    assert got["run firm#0", "boss"]["sense"] is None  # nothing in the instance is like its verb or object
    events = {r["instance"]: r["event"] for r in harvest.chosen_events(rows, scores).collect()}
    assert events["sell car#0"] in ("trade/sale", "sale", "sale-car", "trade-car") and events["run firm#0"].startswith("lead")
    named = spark.createDataFrame([("a", "run", "go/move"), ("b", "run", "none"), ("c", "fly", "move"), ("d", "fly", "none/move")], "instance string, verb string, event string")
    assert sorted(tuple(r) for r in harvest.instance_edges(named).collect()) == [("a", "b", 3.0), ("a", "c", 0.5), ("c", "d", 3.0)]
    assert {tuple(r) for r in harvest.instance_edges(named, "VerbMatch").collect()} == {("a", "b", 3.0), ("c", "d", 3.0)}


def test_schema_table(spark):
    rows = samples(spark)
    scores, members = harvest.slot_scores(rows), spark.createDataFrame([("run race#0", 0, 2.0), ("run firm#0", 0, 1.0), ("sell car#0", 1, 3.0)], "instance string, cluster int, salience double")
    table = harvest.schema_table(members, harvest.chosen_events(rows, scores), scores, models.hashed_encoder()).collect()
    assert {r["cluster"]: r["n_members"] for r in table} == {0: 2, 1: 1} and all(r["slot_score"] is None or r["slot_score"] > 1 / 3 for r in table)


def test_ranks_equal_the_dense_iteration(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = np.triu(rng.integers(0, 3, (9, 9)) * (rng.random((9, 9)) < 0.4), 1).astype(float)
    a, b = np.nonzero(m)
    w = m[a, b]
    assert np.allclose(graph.page_rank(m + m.T), graph.sparse_page_rank(9, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])))


def test_empty(spark):
    none = samples(spark).limit(0)
    assert harvest.slot_scores(none).count() == 0 and harvest.chosen_events(none, harvest.slot_scores(none)).count() == 0
