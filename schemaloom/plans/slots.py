"""Queries of slot aggregation: an instance is a (verb, object head) pair, its samples the sentences with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import graph
from schemaloom.operators import slots as op
from schemaloom.plans import salience
from schemaloom.session import deliver_once, table

VERB_WEIGHT, TYPE_WEIGHT = 3.0, 1.0


def slot_rows(spark: SparkSession, d: str) -> DataFrame:
    """``vo, sample, slot``: the words, no stop words, of each sentence linked to a top pair, in small letters."""
    linked = salience.pair_sentences(spark, d).select(F.concat_ws(" ", "lemma", "head").alias("vo"), F.col("sent_id").alias("sample"))
    tokens = deliver_once(table(spark, d, "corpus_parsed_svo"), "sent_id", ["sent_id", "token_list"])
    words = tokens.select(F.col("sent_id").alias("sample"), F.array_distinct(F.transform(F.filter("token_list", lambda t: t.rlike(r"^\p{L}+$")), lambda t: F.lower(t))).alias("words"))
    # Counted, normalised and joined with itself by what follows, so it is written once.
    rows = linked.join(words, "sample").select("vo", "sample", F.explode("words").alias("slot"))
    return rows.join(salience.stop_words(spark, d).select(F.col("term").alias("slot")), "slot", "left_anti").select("vo", "sample", "slot").checkpoint()


def slot_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return op.slot_scores(slot_rows(spark, d))


def slot_pairs(spark: SparkSession, d: str) -> DataFrame:
    return op.slot_pairs(slot_rows(spark, d))


def slot_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = slot_rows(spark, d)
    ranks = graph.group_page_rank(op.instance_edges(op.slot_scores(rows), op.slot_pairs(rows)), "vo")
    return ranks.select("vo", F.col("node").alias("slot"), F.round("rank", 6).alias("rank"))


def event_choice(spark: SparkSession, d: str) -> DataFrame:
    """Per instance the event candidate (the sentence's first word) with the greatest sum of slot scores."""
    rows = slot_rows(spark, d)
    tokens = deliver_once(table(spark, d, "corpus_parsed_svo"), "sent_id", ["sent_id", "token_list"])
    events = tokens.select(F.col("sent_id").alias("sample"), F.try_element_at("token_list", F.lit(1)).alias("event"))
    scored = op.slot_scores(rows).select("vo", "slot", "score")
    summed = rows.join(events, "sample").join(scored, ["vo", "slot"]).groupBy("vo", "event").agg(F.sum(F.col("score").cast("decimal(18,4)")).cast("double").alias("total"))
    best = summed.where("total is not null and event is not null").groupBy("vo").agg(F.min(F.struct((-F.col("total")).alias("t"), "event")).alias("x"))
    return best.select("vo", "x.event", (-F.col("x.t")).alias("total"))


def instance_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the instances kept (at most salience.TOP): the same verb weighs 3, the same object head 1."""
    top = salience.top_pairs(spark, d).select(F.concat_ws(" ", "lemma", "head").alias("vo"), "lemma", "head")

    def same(key: str, weight: float) -> DataFrame:
        a, b = top.select(F.col("vo").alias("a"), key), top.select(F.col("vo").alias("b"), key)
        return a.join(b, key).where("a < b").select("a", "b", F.lit(weight).alias("w"))

    return same("lemma", VERB_WEIGHT).unionByName(same("head", TYPE_WEIGHT)).groupBy("a", "b").agg(F.sum("w").alias("w"))


def instance_communities(spark: SparkSession, d: str) -> DataFrame:
    nodes = salience.top_pairs(spark, d).select(F.concat_ws(" ", "lemma", "head").alias("node"), (-F.col("score")).alias("position"))
    return graph.communities(nodes, instance_edges(spark, d))


def community_sizes(spark: SparkSession, d: str) -> DataFrame:
    return instance_communities(spark, d).groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first_node")).orderBy(F.desc("n"), "first_node")


def instance_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(instance_edges(spark, d))


def instance_whispers(spark: SparkSession, d: str) -> DataFrame:
    return graph.chinese_whispers(instance_edges(spark, d))


QUERIES = {
    "slots_tfidf": slot_tfidf,
    "slots_pairs": slot_pairs,
    "slots_ranks": slot_ranks,
    "slots_event_choice": event_choice,
    "graph_instance_edges": instance_edges,
    "graph_communities": instance_communities,
    "graph_community_sizes": community_sizes,
    "graph_components": instance_components,
    "graph_whispers": instance_whispers,
}

_SLOTS = salience._SAL + """, tok AS (SELECT DISTINCT sent_id, token_list FROM corpus_parsed_svo),
link AS (SELECT DISTINCT b.lemma || ' ' || b.head AS vo, p.sent_id AS sample FROM best b JOIN pairs p ON p.lemma = b.lemma AND p.head = b.head),
slot AS (SELECT DISTINCT vo, sample, lower(slot) AS slot FROM (SELECT vo, sample, unnest(token_list) AS slot FROM link JOIN tok ON tok.sent_id = sample) WHERE regexp_full_match(slot, '\\p{L}+') AND lower(slot) NOT IN (SELECT term FROM stop)),
loc AS (SELECT vo, slot, count(*) AS local FROM slot GROUP BY ALL), ov AS (SELECT slot, sum(local)::BIGINT AS overall FROM loc GROUP BY ALL),
tf AS (SELECT vo, slot, local, overall, round((1 + pow(log10(local), 2)) * log10((SELECT count(DISTINCT (vo, sample)) FROM slot)::DOUBLE / overall), 4) AS tfidf FROM loc JOIN ov USING (slot)),
sc AS (SELECT *, round((tfidf - min(tfidf) OVER w) / nullif(max(tfidf) OVER w - min(tfidf) OVER w, 0), 4) AS score FROM tf WINDOW w AS (PARTITION BY vo))
"""
_EDGES = salience._SAL + """, vo AS (SELECT lemma || ' ' || head AS vo, lemma, head FROM best),
edge AS (SELECT a.vo AS a, b.vo AS b, (CASE WHEN a.lemma = b.lemma THEN 3.0 ELSE 0 END + CASE WHEN a.head = b.head THEN 1.0 ELSE 0 END)::DOUBLE AS w
  FROM vo a JOIN vo b ON a.vo < b.vo AND (a.lemma = b.lemma OR a.head = b.head))
"""
SQL = {
    "slots_tfidf": _SLOTS + "SELECT vo, slot, local, overall, tfidf, score, coalesce(score >= 1.0 / 3, false) AS kept FROM sc",
    "slots_pairs": _SLOTS + "SELECT x.slot AS a, y.slot AS b, 2 * count(*) AS n FROM slot x JOIN slot y ON x.vo = y.vo AND x.sample = y.sample AND x.slot < y.slot GROUP BY 1, 2",
    "slots_event_choice": _SLOTS + """, ev AS (SELECT vo, token_list[1] AS event, sum(score::DECIMAL(18,4))::DOUBLE AS total FROM slot JOIN tok ON tok.sent_id = sample JOIN sc USING (vo, slot) GROUP BY 1, 2)
SELECT vo, event, total FROM ev WHERE total IS NOT NULL AND event IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vo ORDER BY total DESC, event) = 1""",
    "graph_instance_edges": _EDGES + "SELECT * FROM edge",
    "graph_components": _EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + """, sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
walk(node, seen) AS (SELECT a, a FROM sym UNION SELECT sym.b, walk.seen FROM walk JOIN sym ON sym.a = walk.node)
SELECT node, min(seen) AS component FROM walk GROUP BY node""",
}
