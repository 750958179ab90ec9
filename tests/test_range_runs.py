import random
from collections import Counter, defaultdict

from schemaloom.operators.range_runs import heavy_key_mode


def brute(rows):
    by = defaultdict(Counter)
    for k, v in rows:
        if k is not None and v is not None:
            by[k][v] += 1
    return {k: (sum(c.values()), len(c), *min(((-n, v) for v, n in c.items()))[::-1]) for k, c in by.items()}


def got(df):
    return {r["key"]: (r["n_rows"], r["n_values"], r["top"], -r["n_top"]) for r in df.collect()}


def test_hot_key_nulls_ties_and_repeats(spark):
    random.seed(3)
    rows = [("hot", f"v{random.randint(0, 5)}") for _ in range(3000)] + [(f"k{random.randint(0, 40)}", f"v{random.randint(0, 9)}") for _ in range(1500)]
    rows += [(None, "x"), ("k1", None), ("tie", "b"), ("tie", "a"), ("", ""), ("long", "x" * 100_000)] + [("same", "v")] * 500
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "lemma string, obj string, key int").repartition(7)
    assert got(heavy_key_mode(df, "lemma", "obj")) == brute(rows)


def test_one_key_only(spark):
    rows = [("k", "v")] * 2000
    assert got(heavy_key_mode(spark.createDataFrame(rows, "a string, b string").repartition(5), "a", "b")) == {"k": (2000, 1, "v", -2000)}


def test_empty(spark):
    assert heavy_key_mode(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
