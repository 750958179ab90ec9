import pytest

from schemaloom.llm.mixing import EARLY, FLAT, LATE, in_training_order, integrated, mixture, reached_shares

TARGETS = [("a", 0.5, 1), (" B", 0.3, 2), ("none", 0.1, 3)]


def tables(spark):
    rows = [(i, " A" if i % 2 else "a", 10, "x") for i in range(600)] + [(1000 + i, "b", 7, "x") for i in range(100)] + [(2000, None, 50, "x"), (2001, "other", 1000, "x"), (2002, "a", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, source string, size long, position string"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_demand_is_met_and_repeats_are_capped(spark):
    docs, targets = tables(spark)
    mixed = mixture(docs, "doc_id", "source", "size", targets, {"a": EARLY, "b": LATE})
    rows = mixed.collect()
    total = 6000 + 700 + 1050
    used = {s: [r for r in rows if r["source"] == s] for s in ("a", "b")}
    assert total * 0.5 <= sum(r["size"] for r in used["a"]) < total * 0.5 + 10
    assert sum(r["size"] for r in used["b"]) == 1400 and max(r["epoch"] for r in used["b"]) == 1
    assert all(0 <= r["position"] < 1 for r in rows)
    assert len({(r["item"], r["epoch"]) for r in rows}) == len(rows)
    shares = {r["source"]: r for r in reached_shares(docs, "source", "size", targets, mixed).collect()}
    assert shares["a"]["reachable"] and not shares["b"]["reachable"] and not shares["none"]["reachable"] and shares["none"]["n_uses"] == 0


def test_curriculum_shape(spark):
    docs, targets = tables(spark)
    rows = mixture(docs, "doc_id", "source", "size", targets, {"a": EARLY, "b": LATE}).collect()
    first = lambda s: sum(r["size"] for r in rows if r["source"] == s and r["position"] < 0.5) / sum(r["size"] for r in rows if r["source"] == s)
    assert abs(first("a") - 0.625) < 0.02 and abs(first("b") - 0.375) < 0.03
    order = [r["position"] for r in in_training_order(mixture(docs, "doc_id", "source", "size", targets)).collect()]
    assert order == sorted(order)


def test_schedules():
    assert integrated(FLAT) == [(0.0, 1.0, 1.0, 1.0, 0.0, 1.0)]
    with pytest.raises(ValueError):
        integrated(((0.0, 0.0), (1.0, 0.0)))
    with pytest.raises(ValueError):
        integrated(((0.1, 1.0), (1.0, 1.0)))


def test_empty(spark):
    docs, targets = tables(spark)
    assert mixture(docs.limit(0), "doc_id", "source", "size", targets).count() == 0
    assert mixture(docs, "doc_id", "source", "size", targets.limit(0)).count() == 0
    assert reached_shares(docs.limit(0), "source", "size", targets, mixture(docs.limit(0), "doc_id", "source", "size", targets)).count() == 3


def test_without_schedules_repeated_sources_come_late(spark):
    docs, targets = tables(spark)
    rows = mixture(docs, "doc_id", "source", "size", targets).collect()
    first = lambda s: sum(r["size"] for r in rows if r["source"] == s and r["position"] < 0.5) / sum(r["size"] for r in rows if r["source"] == s)
    assert abs(first("a") - 0.625) < 0.02 and abs(first("b") - 0.375) < 0.03
    shares = {r["source"]: r for r in reached_shares(docs, "source", "size", targets, mixture(docs, "doc_id", "source", "size", targets)).collect()}
    assert abs(sum(r["reached_share"] for r in shares.values()) - 1) < 1e-5 and shares["b"]["share_of_total"] < shares["b"]["reached_share"]
