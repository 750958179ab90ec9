import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.functions.markup import plain_text
from schemaloom.operators import clustering, harvest, models, triples, vectors


def test_chunks_hold_words_whole():
    words = [[i] * (1 + i % 3) for i in range(40)]
    chunks, spans = models.chunked(words, 10)
    assert all(len(c) <= 10 for c in chunks) and all(chunks[c][a:b] == w for (c, a, b), w in zip(spans, words))
    assert all(b[:5] == a[-5:] for a, b in zip(chunks, chunks[1:])) and models.chunked([], 10) == ([[]], [])


def test_vectors_of_words_are_means_of_pieces(spark):
    load = lambda: (lambda w: [ord(c) for c in w], lambda ids: np.array([[i, -i] for i in ids], float).reshape(len(ids), 2))
    df = spark.createDataFrame([(1, ["ab", "c", ""]), (2, None), (3, ["x"] * 1300)], "i int, t array<string>")
    got = {r["i"]: r["vectors"] for r in models.word_vectors(df, "t", load).collect()}
    assert got[1] == [[97.5, -97.5], [99.0, -99.0], [0.0, 0.0]] and got[2] is None and got[3] == [[120.0, -120.0]] * 1300


def test_masked_words(spark):
    load = lambda: lambda texts: [[{"word": w, "prob": 1 / (1 + len(t))} for w in ("b", "a")] + [{"word": "top", "prob": 0.9}] for t in texts]
    df = spark.createDataFrame([(1, ["The", "Dog"], 1), (2, ["x"], 5)], "i int, t array<string>, at int")
    assert [(r["i"], r["place"], r["word"]) for r in models.masked_expansions(df, "i", "t", "at", load, 2).orderBy("place").collect()] == [(1, 0, "top"), (1, 1, "a")]


def test_similarity_over_senses(spark):
    senses = spark.createDataFrame([("dog", "s1"), ("dog", "s2"), ("cat", "s3"), ("hound", "s1")], "word string, sense string")
    paths = spark.createDataFrame([("s3", "s1", 0.2), ("s2", "s3", 0.5)], "s string, t string, similarity double")
    pairs = spark.createDataFrame([("dog", "cat"), ("dog", "hound"), ("dog", "stone")], "a string, b string")
    assert {(r["a"], r["b"]): r["similarity"] for r in models.network_similarity(pairs, senses, paths).collect()} == {("dog", "cat"): 0.5, ("dog", "hound"): 1.0, ("dog", "stone"): 0.0}


def test_joined_and_ordered_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [0.0, 2.0], "x"), (2, [0.0, 0.0], [1.0, 0.0], "x"), (3, [9.0, 9.0], [1.0, 0.0], "y")], "i int, a array<double>, b array<double>, c string")
    assert df.where("i < 3").select(vectors.concatenated(F.col("a"), F.col("b")).alias("v"), "i").orderBy("i").collect()[0]["v"] == pytest.approx([0.6, 0.8, 0.0, 1.0])
    assert [(r["c"], r["i"], r["rank"]) for r in vectors.by_centre(df, "i", "a", "c").orderBy("c", "rank").collect()] == [("x", 1, 1), ("x", 2, 2), ("y", 3, 1)]


def test_purity_of_elements_in_several_clusters(spark):
    kind = "cluster string, element string"
    predicted = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "c"), ("3", "d")], kind)
    gold = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c"), ("y", "d")], kind)
    r = triples.normalised_purity(predicted, gold).first()
    # a weighs one half in 1 and in 2; 1 meets x with 1.5, 2 meets y with 1, 3 is single; of gold x meets 1 with 2, y meets 2 or 3 with 1
    assert (r["purity"], r["inverse_purity"]) == (pytest.approx(2.5 / 4), pytest.approx(3 / 4))
    again = triples.normalised_purity(predicted.withColumn("role", F.lit("v")), gold.withColumn("role", F.lit("v")), ["role"]).first()
    assert again["role"] == "v" and again["f1"] == r["f1"]
    same = triples.purity_scores(predicted.union(predicted), gold).first()
    assert same["purity"] > 0


def test_markup_details():
    assert plain_text("'''''a''''' '''b''' ''c'' ''\"d\"''") == 'a b "c" "d"'
    assert plain_text("<math>x</math> and <math>y</math> and <math>x</math>") == "formula_1 and formula_2 and formula_1"
    assert plain_text("[http://a.b/c x y] [http://a.b http://i.j/k.png] [http://q.r]") == "x y "
    assert plain_text("[http://a.b/c x]", keep_links=True) == '<a href="http://a.b/c">x</a>'
    assert plain_text("a <b>c</b> & d", html_safe=True) == "a c &amp; d" and plain_text("{{x}}!", lambda t: t.replace("{{x}}", "y")) == "y!"


def test_generation(spark):
    def load():
        def model(texts, how):
            if any("bad" in t for t in texts):
                raise RuntimeError("too long")
            return [[f"{t} {how.length} {i}" for i in range(how.sequences)] for t in texts]

        return model

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "b")], "i int, prompt string")
    rows = models.generated(df, "prompt", load, models.Generation(length=8, sequences=2)).orderBy("i", "sequence_no").collect()
    assert [(r["i"], r["sequence_no"], r["raw"]) for r in rows] == [(1, 0, "a 8 0"), (1, 1, "a 8 1"), (4, 0, "b 8 0"), (4, 1, "b 8 1")]
    with pytest.raises(ValueError):
        models.Generation(length=257)


def test_bags_overlap_and_type_similarity(spark):
    a, b = F.array(F.lit("x"), F.lit("y"), F.lit("x")), F.array(F.lit("y"), F.lit("x"), F.lit("x"))
    row = spark.range(1).select(
        harvest.same_bag(a, b).alias("same"), harvest.same_bag(a, F.array(F.lit("x"))).alias("other"), harvest.lexical_overlap(a, b).alias("overlap"),
        harvest.type_similarity(F.lit("Go/Move "), F.lit("move")).alias("half"), harvest.type_similarity(F.lit("none/x"), F.lit("none/x")).alias("none")).first()
    assert (row["same"], row["other"], row["half"], row["none"]) == (1, 0, 0.5, 0.0) and row["overlap"] == pytest.approx(5 / 9)


def test_weighted_distance_and_frames_of_triples(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], 3.0), ([1.0, 0.0], [2.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 9.0)], "a array<double>, b array<double>, w double")
    assert vectors.mean_distance(df, "a", "b", "w").first()["distance"] == 0.75 and vectors.mean_distance(df, "a", "b").first()["distance"] == 0.5
    words = spark.createDataFrame([(w, [1.0, 0.01 * i] if w < "m" else [0.01 * i, 1.0]) for i, w in enumerate("abcxyz")], "word string, vector array<double>")
    rows = spark.createDataFrame([("a", "b", "c"), ("b", "a", "c"), ("c", "b", "a"), ("x", "y", "z"), ("y", "x", "z"), ("z", "y", "x"), ("a", "q", "b")], "p string, s string, o string")
    found = {(r["p"], r["s"]): r["cluster"] for r in clustering.whispered_frames(rows, ["p", "s", "o"], [words] * 3, 2).collect()}
    assert len(found) == 6 and len({found[p] for p in found if p[0] < "m"}) == 1 and len(set(found.values())) == 2
    kept = triples.without_pronouns(spark.createDataFrame([("It",), ("dog",)], "term string"))
    assert [r["term"] for r in kept.collect()] == ["dog"]
