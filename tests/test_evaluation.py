"""Queries on tables made for what the generated ones do not have."""

import itertools
import math
from collections import Counter
from datetime import datetime

import pytest

from schemaloom.operators import triples, vectors
from schemaloom.plans import evaluation

CORPUS = "sent_id long, text string, dataset string, arrived_at timestamp_ntz"


def test_reciprocal_rank_weights(spark):
    lists = spark.createDataFrame([("k", ["a", "b", "a"]), ("k", ["b"]), ("m", ["c", "c", "a"]), ("m", [])], "k string, t array<string>")
    got = {(r["k"], r["term"]): (r["rank"], r["weight"]) for r in vectors.reciprocal_rank_weights(lists, "k", "t").collect()}
    at = {n: 1 / math.log(1 + n) for n in (1, 2, 3)}
    want = {("k", "a"): (1, at[1]), ("k", "b"): (1, at[2] + at[1]), ("m", "c"): (1, at[1]), ("m", "a"): (3, at[3])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_expansion_weights_by_month(spark, tmp_path):
    often = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50)]
    march, april, none = datetime(2024, 3, 31, 23, 59), datetime(2024, 4, 1), None
    rows = [(1, " ".join(often * 3), "x", march), (2, "rare", "x", april), (2, "rare", "x", march.replace(month=5)), (3, often[1], "x", none), (4, often[1], "y", april)]
    spark.createDataFrame(rows, CORPUS).write.parquet(f"{tmp_path}/corpus.parquet")
    got = {(r["dataset"], r["term"]): (r["rank"], r["weight"]) for r in evaluation.expansion_weights(spark, str(tmp_path)).collect()}
    one = round(1 / math.log(2), 6)
    assert got["x", "rare"] == (1, one)  # of no rank among the data set's 50 words; its second delivery does not count
    assert got["x", often[1]] == (1, pytest.approx(1 / math.log(2) + 1 / math.log(3), abs=1e-6)) and got["y", often[1]] == (1, one)
    assert got["x", often[49]] == (50, pytest.approx(1 / math.log(51), abs=1e-6)) and len(got) == 52


def test_bootstrap_f1(spark):
    """Each draw is some choice with replacement, and the draws spread over the choices as often as they should."""
    rows = [("p1", "a", "g1"), ("p1", "b", "g1"), ("p1", "c", "g2"), ("p2", "d", "g2"), ("p2", "e", "g2"), ("p3", "f", "g3")]
    df = spark.createDataFrame(rows, "p string, element string, g string")
    got = triples.purity_bootstrap(df.selectExpr("p as cluster", "element"), df.selectExpr("g as cluster", "element")).collect()
    assert sorted(r["draw"] for r in got) == list(range(1, 1001))
    scores = {}
    for choice in itertools.product(["p1", "p2", "p3"], repeat=3):
        mine = [r for r in rows if r[0] in choice]
        n = Counter((p, g) for p, _, g in mine)
        size = Counter(p for p, _, _ in mine)
        pu = sum(max(k for (q, _), k in n.items() if q == p) for p in size if size[p] > 1) / len(mine)
        ipu = sum(max(k for (_, h), k in n.items() if h == g) for g in {g for _, g in n}) / len(rows)
        scores[choice] = (round(pu, 6), round(ipu, 6), round(2 * pu * ipu / (pu + ipu), 6) if pu + ipu else None)
    share, seen = Counter(scores.values()), Counter((r["purity"], r["inverse_purity"], r["f1"]) for r in got)
    assert seen.keys() == share.keys() and all(abs(seen[k] / 1000 - n / 27) < 0.06 for k, n in share.items())


def test_bootstrap_is_of_f1(spark, small):
    assert evaluation.QUERIES["metrics_bootstrap"](spark, small).where("f1 between 0 and 1").count() == 1000
