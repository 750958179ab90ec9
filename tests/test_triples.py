"""Joins of triples with each other and with entity spans."""

from schemaloom.operators import triples


def test_pairs_sharing_two_fields(spark):
    rows = [(1, "eat", "dog", "meat"), (2, "eat", "dog", "fish"), (3, "see", "dog", "meat"), (4, "eat", "dog", "meat"), (5, "go", None, "x"), (6, "run", None, "x"), (7, "go", "man", "y")]
    df = spark.createDataFrame(rows, "id int, verb string, subject string, object string")
    got = [(r["a"], r["b"]) for r in triples.sharing_two(df, "id", ["verb", "subject", "object"]).collect()]
    assert sorted(got) == [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4), (5, 6)]


def test_entities_that_hold_an_end_of_the_object(spark):
    objects = spark.createDataFrame([(1, "a", [3, 4, 5]), (1, "b", [9]), (2, "c", [3]), (1, "d", [])], "sent int, o string, idx array<int>")
    entities = spark.createDataFrame([(1, "first", 2, 4), (1, "last", 5, 6), (1, "inner", 4, 5), (1, "open", 6, 9), (2, "other", 3, 4)], "sent int, e string, start int, end int")
    got = sorted((r["o"], r["e"]) for r in triples.overlapping_entities(objects, entities, "sent").collect())
    assert got == [("a", "first"), ("a", "last"), ("c", "other")]
