from collections import Counter

from pyspark.sql import functions as F

from schemaloom.llm.termfreq import long_record_terms, marked, record_terms, term_frequencies, words_of

TEXTS = [(1, "The cat, the CAT"), (2, "cat's the"), (3, None), (4, ""), (5, "é́a 12 b2c"), (6, "the " * 3000)]


def test_both_ways_agree_with_counting(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "sent_id long, text string, key string").select("sent_id", words_of(F.col("text")).alias("terms"), "key")
    occurrences, records = Counter(), Counter()
    for _, t in TEXTS:
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        occurrences.update(words)
        records.update(set(words))
    want = {w: (n, records[w]) for w, n in occurrences.items()}
    for pairs in (record_terms(df, "sent_id", "terms"), long_record_terms(df, "sent_id", "terms")):
        assert {r["term"]: (r["n_occurrences"], r["n_records"]) for r in term_frequencies(pairs).collect()} == want


def test_marks(spark):
    rows = spark.createDataFrame([("a", 9, 30), ("b", 9, 2), ("c", 9, 5)], "term string, n_occurrences long, n_records long")
    total = spark.createDataFrame([(100,)], "n_all long")
    assert {r["term"]: r["mark"] for r in marked(rows, total).collect()} == {"a": "common", "b": "rare", "c": None}


def test_empty(spark):
    df = spark.createDataFrame([], "sent_id long, terms array<string>")
    assert term_frequencies(long_record_terms(df, "sent_id", "terms")).count() == 0
