"""Paths longer than any fixed number of hops, and the labels along them."""

from schemaloom.operators import graph


def test_shortest_paths_of_any_length(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(19)] + [("n19", "n03"), ("n05", "n02"), ("x", "y")]
    got = {r["node"]: r["hops"] for r in graph.shortest_paths(spark.createDataFrame(chain, "a string, b string"), "n00").collect()}
    assert got == {f"n{i:02}": i for i in range(20)}


def test_labelled_paths(spark):
    nodes = spark.createDataFrame([(1, i, f"w{i}") for i in range(1, 18)] + [(2, 1, "one")], "graph int, node int, label string")
    edges = spark.createDataFrame([(1, i, i + 1, f"d{i}") for i in range(1, 16)] + [(2, 1, 2, "x"), (2, 1, 2, "obj")], "graph int, a int, b int, label string")
    pairs = spark.createDataFrame([(1, 1, 3), (1, 3, 1), (1, 1, 16), (1, 1, 17), (2, 2, 1), (2, 1, 1)], "graph int, a int, b int")
    got = {(r["graph"], r["a"], r["b"]): (r["words"], r["deps"], r["deps_n_words"]) for r in graph.labelled_paths(nodes, edges, pairs).collect()}
    assert got[1, "1", "3"] == got[1, "3", "1"] == ("w1-->w2", "d1-->d2", "w1--d1--w2:w2--d2--w3")
    assert got[1, "1", "16"][1].count("-->") == 14 and got[1, "1", "17"] == got[2, "1", "1"] == ("", "", "")
    assert got[2, "2", "1"] == ("one", "obj", "one--obj--2")
