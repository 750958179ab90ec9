import numpy as np
import pandas as pd

from schemaloom.llm.reservoir import big_hypergeometric, hypergeometric_merge, reservoir_sample, rows_of_sample, sample_records, skip_reservoir


def test_skips_are_uniform():
    hits = np.zeros(60)
    for seed in range(4000):
        held, seen = skip_reservoir(iter([pd.DataFrame({"i": range(0, 25)}), pd.DataFrame({"i": range(25, 60)})]), 6, np.random.default_rng(seed))
        assert seen == 60 and len(held) == 6 and held["i"].is_unique
        hits[held["i"]] += 1
    expected = 4000 * 6 / 60
    assert ((hits - expected) ** 2 / expected).sum() < 100  # 59 degrees of freedom


def test_merge_is_uniform():
    hits = np.zeros(50)
    for seed in range(4000):
        rng = np.random.default_rng(seed)
        a, b = np.arange(10), np.arange(10, 50)
        parts = [(pd.DataFrame({"i": rng.choice(a, 5, replace=False)}), 10), (pd.DataFrame({"i": rng.choice(b, 5, replace=False)}), 40)]
        rows, total = hypergeometric_merge(parts, 5, rng)
        assert total == 50 and len(rows) == 5
        hits[rows["i"]] += 1
    assert ((hits - 400) ** 2 / 400).sum() < 90


def test_large_populations():
    rng = np.random.default_rng(1)
    got = np.mean([big_hypergeometric(rng, 10**12, 3 * 10**12, 400) for _ in range(300)])
    assert 90 < got < 110


def test_sample_over_partitions(spark):
    df = spark.range(2000).selectExpr("id as sent_id", "cast(id as string) as text", "1 as _seen_before")
    rows = reservoir_sample(df, "sent_id", 100, seed=3, partitions=20).collect()
    again = reservoir_sample(df.repartition(7), "sent_id", 100, seed=3, partitions=20).collect()
    assert len({r["sent_id"] for r in rows}) == 100 and rows[0]["n_population"] == 2000
    assert {r["sent_id"] for r in rows} == {r["sent_id"] for r in again}


def test_fewer_than_size_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "sent_id long, text string")
    assert sorted(r["sent_id"] for r in reservoir_sample(df, "sent_id", 10, partitions=9).collect()) == [1, 2]
    assert reservoir_sample(df.limit(0), "sent_id", 10).count() == 0


def test_ids_are_drawn_before_rows_are_fetched(spark):
    df = spark.range(900).selectExpr("id div 3 as sent_id", "repeat('x', 50) as text").unionByName(spark.createDataFrame([(None, "y")], "sent_id long, text string"))
    sample = sample_records(df, "sent_id", 40)
    rows = rows_of_sample(df, "sent_id", sample).collect()
    assert len(rows) == 120 and len({r["sent_id"] for r in rows}) == 40 and {r["n_population"] for r in rows} == {300}
