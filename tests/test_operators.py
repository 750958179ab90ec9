import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from schemaloom.functions.markup import compact_lines, internal_links, normalised_title, page_text, plain_text, without_nested
from schemaloom.operators.ranking import ranked
from schemaloom.operators import corpus, graph, metrics, models, prompts, salience, slots, svo_rules, triples, vectors


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text_filters(spark):
    rows = [(1, "12345", False), (2, "x" * 255, True), (3, "x" * 256, True), (4, "", False), (5, None, False), (6, "a\xa0b　c", False), (7, "一二三", True), (8, "w " * 300, False)]
    df = spark.createDataFrame(rows, "i int, t string, zh boolean")
    got = {r["i"]: (r["length"], r["too_long"], r["too_numeric"]) for r in corpus.with_filters(df, "t", F.col("zh")).collect()}
    assert got[1] == (1, False, True) and got[2][1] is False and got[3][1] is True and got[4] == (0, False, False)
    assert got[5][0] is None or got[5][0] == -1 or got[5][1] is None
    assert got[6][0] == 3 and got[7][2] is True and got[8] == (300, True, False)


def test_sentence_splitters(spark):
    assert one(spark, corpus.split_chinese(F.lit("甲。乙？！丙"))) == ["甲。", "乙？！"]
    assert one(spark, corpus.split_chinese(F.lit("没有结尾"))) == []
    assert one(spark, corpus.repaired_opening(F.lit("is a town"), F.lit("X"))) == "X is a town"


def test_salience_and_budget(spark):
    local = spark.createDataFrame([("a", 10), ("b", 5), ("c", 1), ("the", 100)], "term string, freq long")
    scored = salience.with_salience(local, spark.createDataFrame([("a", 1000), ("b", 10), ("the", 10**7)], "term string, freq long"))
    got = {r["term"]: r["salience"] for r in scored.collect()}
    assert got["a"] == 10.0 and got["c"] == -1.0
    stop = spark.createDataFrame([("the",)], "term string")
    assert [r["term"] for r in salience.top_terms(scored, stop, 0.5, 1).collect()] == ["b", "a"]
    assert salience.top_terms(scored, stop, 0.1, 1).count() == 3  # a budget of 0 takes all


def test_completions_and_batches(spark):
    parse = lambda s: one(spark, prompts.parsed_completion(F.lit(s)))
    assert parse("make plan & Attack b a b")["slots"] == ["a", "b"] and parse("v o &")["event"] == "none" and parse("v o & single")["event"] == "none"
    df = spark.createDataFrame([("k", i) for i in range(7)] + [("m", 0)], "k string, i int")
    got = sorted((r["k"], r["i"], r["batch"]) for r in prompts.batches(df, "k", "i").collect())
    assert got == [("k", i, i // 3) for i in range(6)]


def test_slot_scores_constant_instance_keeps_nothing(spark):
    rows = [("v", 1, "a"), ("v", 1, "b"), ("w", 2, "a"), ("w", 2, "c"), ("w", 3, "c"), ("s", 4, "z")]
    got = {(r["vo"], r["slot"]): r for r in slots.slot_scores(spark.createDataFrame(rows, "vo string, sample long, slot string")).collect()}
    assert got["s", "z"]["score"] is None and not got["s", "z"]["kept"] and got["w", "c"]["kept"]
    pairs = {(r["a"], r["b"]): r["n"] for r in slots.slot_pairs(spark.createDataFrame(rows, "vo string, sample long, slot string")).collect()}
    assert pairs == {("a", "b"): 2, ("a", "c"): 2}


def test_page_rank():
    rank = graph.page_rank(np.array([[0, 1, 1], [1, 0, 0], [1, 0, 0]], float))
    assert rank[0] > rank[1] == pytest.approx(rank[2]) and rank.sum() == pytest.approx(1, abs=1e-4)
    assert graph.page_rank(np.zeros((2, 2))).sum() < 1  # mass of dangling nodes is lost


def test_louvain_separates_cliques_and_keeps_single_nodes():
    nodes = list("abcdefx")
    edges = dict.fromkeys([*itertools.combinations("abc", 2), *itertools.combinations("def", 2)], 3.0) | {("c", "d"): 0.0}
    found = graph.louvain(nodes, edges)
    assert len({found[x] for x in "abc"}) == 1 and len({found[x] for x in "def"}) == 1 and len(set(found.values())) == 3
    assert graph.louvain(["a"], {}) == {"a": 0}


def test_components_and_whispers(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0), ("p", "q", 1.0), ("q", "r", 1.0), ("r", "s", 1.0)], "a string, b string, w double")
    assert {r["node"]: r["component"] for r in graph.components(edges).collect()} == dict(zip("abcxypqrs", "aaaxxpppp"))
    labels = {r["node"]: r["label"] for r in graph.chinese_whispers(edges.where("a <> 'q'"), 5).collect()}
    assert set(labels) == set("abcxypqrs")
    assert {r["node"]: r["hops"] for r in graph.shortest_paths(edges, "p").collect()} == {"p": 0, "q": 1, "r": 2, "s": 3}


def test_cluster_scores(spark):
    def scores(pairs):
        return metrics.cluster_scores(metrics.contingency(spark.createDataFrame(pairs, "g string, p string"), "g", "p")).first()

    same = scores([("a", "1"), ("a", "1"), ("b", "2")])
    assert same["ari"] == 1 and same["nmi"] == 1 and same["b3_f"] == 1 and same["purity"] == 1
    mixed = scores([("a", "1"), ("a", "1"), ("a", "2"), ("b", "2"), ("b", "3"), ("b", "3")])
    assert mixed["ari"] == pytest.approx(0.242424, abs=1e-5) and mixed["purity"] == pytest.approx(5 / 6, abs=1e-5)
    assert scores([("a", "1"), ("b", "1")])["b3_recall"] == 1


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 6):
        m = rng.integers(0, 20, (n, n)).astype(float)
        best = max(m[np.arange(n), list(p)].sum() for p in itertools.permutations(range(n)))
        assert m[np.arange(n), metrics.best_assignment(m)].sum() == best


def test_raters(spark):
    votes = spark.createDataFrame([(i, v) for i, vs in enumerate(["yyy", "yyn", "nnn", "ynn"]) for v in vs], "item int, vote string")
    row = metrics.rater_agreement(votes).first()
    assert row["agreement"] == pytest.approx(2 / 3, abs=1e-6) and row["fleiss_kappa"] == pytest.approx(1 / 3, abs=1e-6) and row["randolph_kappa"] == pytest.approx(1 / 3, abs=1e-6)
    assert {r["item"]: (r["vote"], r["unanimous"]) for r in metrics.majority(votes).collect()}[1] == ("y", False)


def test_nearest_and_rbo(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    got = {}
    for r in vectors.nearest(df, "id", "v", df.where("id < 5"), 3, blocks=4).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["item"]
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(5):
        s = unit @ unit[q]
        s[q] = -9
        assert [got[q][k] for k in (1, 2, 3)] == np.argsort(-s)[:3].tolist()
    assert one(spark, vectors.rank_biased_overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a")), 2)) == 0.5


def test_ward():
    points = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    label = vectors.ward(points, 3)
    assert label[0] == label[1] and label[2] == label[3] and len(set(label)) == 3


def test_triple_tools(spark):
    assert one(spark, triples.without_pos(F.lit("a#b#NN"))) == "a#b" and one(spark, triples.without_pos(F.lit("#x"))) == "#x"
    assert one(spark, triples.generalised(F.lit("he"), F.lit("PRP"))) == "PERSON"
    rows = triples.repeated(spark.createDataFrame([("a", 25), ("b", 9)], "t string, w int"), F.floor(F.col("w") / 10))
    assert rows.count() == 2


def test_ranks_of_hot_keys(spark):
    rows = [("hot", i) for i in range(900)] + [(None, i) for i in range(5)] + [("b", 1)]
    got = sorted(((r["k"] or "", r["i"], r["rank"]) for r in ranked(spark.createDataFrame(rows, "k string, i int").repartition(5), ["k"], [F.col("i")]).collect()))
    assert got == sorted((k or "", i, i + 1 if k != "b" else 1) for k, i in rows)
    whole = ranked(spark.range(100), [], [F.desc("id")])
    assert {r["id"]: r["rank"] for r in whole.collect()} == {i: 100 - i for i in range(100)}


SENTENCE = [("dogs", "dog", "NOUN", "nsubj", 3), ("and", "and", "CCONJ", "cc", 0), ("cats", "cat", "NOUN", "conj", 0), ("chased", "chase", "VERB", "ROOT", 3), ("mice", "mouse", "NOUN", "dobj", 3)]
PASSIVE = [("mice", "mouse", "NOUN", "nsubjpass", 3), ("were", "be", "AUX", "auxpass", 3), ("not", "not", "PART", "neg", 3), ("chased", "chase", "VERB", "ROOT", 3), ("by", "by", "ADP", "agent", 3), ("dogs", "dog", "NOUN", "pobj", 4)]


def test_svo_rules(spark):
    df = spark.createDataFrame([(1, SENTENCE), (2, PASSIVE), (3, None), (4, [])], f"i int, t {svo_rules.TOKENS}")
    got = {r["i"]: [(s["subj"] and s["subj"]["text"], s["verb"]["lemma"], s["obj"] and s["obj"]["text"]) for s in r["svos"]] for r in svo_rules.extract(df, ["i"], "t").collect()}
    assert got == {1: [("dogs and", "chase", "mice"), ("cats", "chase", "mice")], 2: [("dogs", "!chase", "mice")], 3: [], 4: []} or got[1][1] == ("cats", "chase", "mice")
    assert got[2] == [("dogs", "!chase", "mice")] and got[3] == []


def test_models_and_windows(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "i int, t string")
    got = {r["i"]: r["e"] for r in models.apply_model(df, "t", models.hashed_encoder(8), "e", "array<float>").collect()}
    assert len(got[1]) == 8 and got[2] is None
    long = spark.createDataFrame([(list(range(12)),), ([1],)], "x array<int>")
    assert sorted(r["window"] for r in models.windows(long, "x", 6, 3).collect()) == [[0, 1, 2, 3, 4, 5], [1], [3, 4, 5, 6, 7, 8], [6, 7, 8, 9, 10, 11]]
    assert models.bigram_similarity("abc", "abc") == 1


def test_markup(spark):
    assert without_nested("a{{b{{c}}d}}e{{f", "{{", "}}") == "ae{{f"
    assert internal_links("see [[Page|the page]]s, [[X]] [[File:a.jpg|thumb|with [[Y]]]].") == "see the pages, X ."
    assert plain_text("'''Bold''' [http://x y z] <ref>no</ref>&amp; <!-- c -->t__TOC__") == "Bold y z & t"
    assert compact_lines("==Empty==\n==Full==\n===Sub===\ntext\n* item\n()\nmore") == ["Full", "Sub", "text", "more"]
    assert one(spark, normalised_title(F.lit(" a_b  c "))) == "A b c"
    df = spark.createDataFrame([("==H==\nx {{t}}",), (None,)], "p string")
    assert {r["x"] for r in df.select(page_text("p").alias("x")).collect()} == {"H\nx", None}


def test_streaming(spark, tmp_path):
    from schemaloom.streaming import ingest

    rows = pd.DataFrame({"sent_id": [1, 1, 2], "text": ["a b", "a b", "99"], "dataset": ["x_en"] * 3, "doc_key": ["d"] * 3, "piece_no": [1, 1, 1], "arrived_at": pd.to_datetime(["2024-03-01 00:00:01"] * 3)})
    rows = rows.astype({"piece_no": "int32"})
    rows["arrived_at"] = rows["arrived_at"].astype("datetime64[us]")
    (tmp_path / "in").mkdir()
    rows.to_parquet(tmp_path / "in" / "a.parquet")
    stream = ingest.cleaned(ingest.once_each(ingest.arriving(spark, str(tmp_path / "in")))).select("sent_id", "text")
    ingest.into_table(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [r["sent_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_that_stands_for_its_antecedent_and_negations_stay_out():
    rows = [("the", "the", "DET", "det", 1), ("dog", "dog", "NOUN", "nsubj", 4), ("that", "that", "PRON", "nsubj", 3), ("barked", "bark", "VERB", "relcl", 1), ("chased", "chase", "VERB", "ROOT", 4), ("no", "no", "DET", "det", 6), ("cats", "cat", "NOUN", "dobj", 4), ("and", "and", "CCONJ", "cc", 6), ("birds", "bird", "NOUN", "conj", 6)]
    s = svo_rules.Sentence([dict(zip(("text", "lemma", "pos", "dep", "head"), r)) for r in rows])
    assert s.span(s.tokens[2])["text"] == "the dog"
    assert s.span(s.tokens[6])["text"] == "cats" and s.has_conjunction(s.tokens[6], True) and not s.has_conjunction(s.tokens[1])
    assert [o.text for o in s.objects(s.tokens[4], False)] == ["cats", "birds"]
