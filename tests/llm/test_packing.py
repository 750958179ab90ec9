import itertools
import random
from collections import Counter

from schemaloom.llm.packing import best_fill, bin_fill, pack, plan_bins


def test_best_fill_against_all_subsets():
    random.seed(2)
    for _ in range(300):
        items = [random.randint(1, 12) for _ in range(random.randint(0, 8))]
        space = random.randint(0, 30)
        best = max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= space)
        counts = Counter(items)
        fill = best_fill(sorted(counts, reverse=True), dict(counts), space)
        assert sum(a * n for a, n in fill) == best and all(n <= counts[a] for a, n in fill)


def test_plan_places_every_item_once():
    random.seed(4)
    histogram = Counter(random.randint(1, 100) for _ in range(5000))
    rows = plan_bins(dict(histogram), 100)
    load, covered = Counter(), Counter()
    for length, a, b, per, at in rows:
        covered[length] += b - a
        for rank in range(a, b):
            load[at + (rank - a) // per] += length
    assert covered == histogram and max(load.values()) <= 100
    total = sum(a * n for a, n in histogram.items())
    assert len(load) <= -(-total // 100) * 1.01 + 1


def test_pack_whole_and_split(spark):
    random.seed(5)
    rows = [(i, random.randint(1, 40), "x") for i in range(500)] + [(1000, 250, "x"), (1001, 100, "x"), (1002, 0, "x"), (1003, None, "x"), (1004, 101, "x")]
    df = spark.createDataFrame(rows, "doc_id long, size long, length string")
    spec = spark.createDataFrame([("p", 100), ("q", 60), (None, 5), ("bad", 0)], "pack_name string, capacity int")
    contents, _ = pack(df, "doc_id", "size", spec)
    got = contents.collect()
    for name, capacity in (("p", 100), ("q", 60)):
        mine = [r for r in got if r["pack_name"] == name]
        load, size = Counter(), Counter()
        for r in mine:
            load[r["bin"]] += r["length"]
            size[r["item"]] += r["length"]
        assert max(load.values()) <= capacity
        assert size == Counter({i: s or 0 for i, s, _ in rows})
        assert all((r["n_pieces"] > 1) == (size[r["item"]] > capacity) for r in mine)
        assert len(mine) == len({(r["item"], r["piece"]) for r in mine})
    assert {r["pack_name"] for r in got} == {"p", "q"}
    assert bin_fill(contents, spec).where("slack < 0").count() == 0


def test_one_hot_length_and_empty(spark):
    spec = spark.createDataFrame([("p", 10)], "pack_name string, capacity int")
    hot, _ = pack(spark.range(3000).selectExpr("id", "3 as size"), "id", "size", spec)
    assert hot.select("bin").distinct().count() == 1000
    none, _ = pack(spark.range(0).selectExpr("id", "3 as size"), "id", "size", spec)
    assert none.count() == 0
