"""p8_found and p9_found are read off the packing and the mixture, not beside them."""

import pytest

from schemaloom.llm import mixing, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("found"))
    rows = [(i, "a" if i % 2 else "b", "x" * (3 + i % 40)) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{d}/documents.parquet")
    targets = [("a", 0.9, 1), ("B ", 0.3, 1), ("none", 0.1, 3), ("zero", 0.0, 1)]
    spark.createDataFrame(targets, "source string, target_share double, max_repeats int").write.parquet(f"{d}/mix_target.parquet")
    spark.createDataFrame([("p", 20)], "pack_name string, capacity int").write.parquet(f"{d}/pack_spec.parquet")
    return d


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_found_reads_the_mixture(spark, folder):
    found = queries.p9_found(spark, folder)
    assert sorted(r["source"] for r in found.collect()) == ["a", "none"]
    assert "offset#" in plan_of(found) and "position#" in plan_of(found)
    shares = {r["source"]: r for r in queries.reached(spark, folder).collect()}
    assert all(r["ended_size"] == (r["used_size"] or None) for r in shares.values())
    assert shares["b"]["ended_size"] >= shares["b"]["wanted_size"] and shares["a"]["ended_size"] < shares["a"]["wanted_size"]


def test_found_reads_the_containers(spark, folder):
    found = queries.p8_found(spark, folder)
    assert {r["doc_id"] for r in found.collect()} == {i for i in range(400) if 3 + i % 40 > 20}
    assert "row_number" in plan_of(found)
