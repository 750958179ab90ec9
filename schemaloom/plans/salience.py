"""Queries of term statistics, salience and salient pairs over the parsed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.svo import triples_once
from schemaloom.operators import salience as op
from schemaloom.session import deliver_once, table, with_checkpoints

TOP = 500


def triples(spark: SparkSession, d: str) -> DataFrame:
    return triples_once(table(spark, d, "corpus_parsed_svo"))


def background(spark: SparkSession, d: str) -> DataFrame:
    once = deliver_once(table(spark, d, "enwiki"), "sent_id", ["sent_id", "text"])
    return op.term_counts(once.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")), "word")


def stop_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "common_words").select(F.lower("word").alias("term")).distinct()


def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    once = deliver_once(table(spark, d, "corpus_parsed_svo"), "sent_id", ["sent_id", "token_list"])
    return op.term_counts(once.select(F.explode("token_list").alias("token")), "token")


def verb_frequency(spark: SparkSession, d: str) -> DataFrame:
    return op.term_counts(triples(spark, d), "lemma")


def object_frequency(spark: SparkSession, d: str) -> DataFrame:
    return op.term_counts(triples(spark, d), "obj")


def head_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Object counts rolled up to their heads; phrases with irregular blanks stay out."""
    counts = object_frequency(spark, d).where(op.regular_phrase(F.col("term")))
    return counts.groupBy(op.head_of(F.col("term")).alias("term")).agg(F.sum("freq").alias("freq"))


def negation(spark: SparkSession, d: str) -> DataFrame:
    rows = triples(spark, d).where("lemma is not null")
    return rows.groupBy("lemma").agg(F.count(F.lit(1)).alias("n"), F.count_if("negated").alias("n_negated"), F.count_if(F.col("obj").isNull()).alias("n_without_object"))


def verb_salience(spark: SparkSession, d: str) -> DataFrame:
    return op.with_salience(verb_frequency(spark, d), background(spark, d))


def head_salience(spark: SparkSession, d: str) -> DataFrame:
    return op.with_salience(head_frequency(spark, d), background(spark, d))


def salient_verbs(spark: SparkSession, d: str) -> DataFrame:
    return op.top_terms(verb_salience(spark, d), stop_words(spark, d), 0.8, 5)


def salient_heads(spark: SparkSession, d: str) -> DataFrame:
    return op.top_terms(head_salience(spark, d), stop_words(spark, d), 0.8, 3)


def salient_pairs(spark: SparkSession, d: str) -> DataFrame:
    return op.salient_pairs(triples(spark, d), salient_verbs(spark, d), salient_heads(spark, d))


def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    return op.top_pairs(salient_pairs(spark, d), TOP)


def pair_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Each linked sentence of a salient pair, once; a pair's list is the rows with its key."""
    with_checkpoints(spark)
    every = salient_pairs(spark, d).checkpoint()  # read twice: for the best pairs and for their sentences
    linked = every.select("lemma", "head", "sent_id").distinct()
    return op.top_pairs(every, TOP).join(linked, ["lemma", "head"], "left")


QUERIES = {
    "stats_token_frequency": token_frequency,
    "stats_verb_frequency": verb_frequency,
    "stats_object_frequency": object_frequency,
    "stats_head_frequency": head_frequency,
    "stats_negation": negation,
    "stats_verb_salience": verb_salience,
    "stats_head_salience": head_salience,
    "stats_salient_verbs": salient_verbs,
    "stats_salient_heads": salient_heads,
    "pairs_salient": salient_pairs,
    "pairs_top": top_pairs,
    "pairs_sentences": pair_sentences,
}

B = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
TRIPLES = rf"""
WITH triple AS (SELECT sent_id, unnest(svos) AS s FROM (SELECT DISTINCT sent_id, svos FROM corpus_parsed_svo)),
t AS (SELECT sent_id,
  nullif(lower(trim(regexp_replace(s.subj.text, '{B}+', ' ', 'g'))), '') AS subj,
  nullif(lower(regexp_replace(regexp_replace(s.verb.lemma, '^{B}+|{B}+$', '', 'g'), '^!{B}*', '')), '') AS lemma,
  coalesce(starts_with(regexp_replace(s.verb.lemma, '^{B}+', ''), '!'), false) AS negated,
  nullif(lower(trim(regexp_replace(s.obj.text, '{B}+', ' ', 'g'))), '') AS obj FROM triple WHERE s IS NOT NULL)
"""
_SAL = TRIPLES + """, words AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM (SELECT DISTINCT sent_id, text FROM enwiki)),
bg AS (SELECT term, count(*) AS background FROM words GROUP BY term),
verb AS (SELECT lemma AS term, count(*) AS freq FROM t WHERE lemma IS NOT NULL GROUP BY 1),
head AS (SELECT string_split(obj, ' ')[-1] AS term, count(*) AS freq FROM t WHERE obj IS NOT NULL GROUP BY 1),
vs AS (SELECT term, freq, round(coalesce((1 + pow(log10(freq), 2)) * log10(1e8 / background), -1), 4) AS salience FROM verb LEFT JOIN bg USING (term)),
hs AS (SELECT term, freq, round(coalesce((1 + pow(log10(freq), 2)) * log10(1e8 / background), -1), 4) AS salience FROM head LEFT JOIN bg USING (term)),
stop AS (SELECT DISTINCT lower(word) AS term FROM common_words),
vt AS (SELECT * FROM (SELECT * FROM vs WHERE term NOT IN (SELECT term FROM stop) QUALIFY row_number() OVER (ORDER BY salience DESC, term) <= (SELECT floor(count(*) * 0.8) FROM vs)) WHERE freq >= 5),
ht AS (SELECT * FROM (SELECT * FROM hs WHERE term NOT IN (SELECT term FROM stop) QUALIFY row_number() OVER (ORDER BY salience DESC, term) <= (SELECT floor(count(*) * 0.8) FROM hs)) WHERE freq >= 3),
pairs AS (SELECT sent_id, lemma, ht.term AS head, round(vt.salience * ht.salience, 4) AS score FROM t JOIN vt ON lemma = vt.term JOIN ht ON string_split(obj, ' ')[-1] = ht.term),
best AS (SELECT DISTINCT lemma, head, score FROM pairs ORDER BY score DESC, lemma, head LIMIT 500)
"""

SQL = {
    "stats_token_frequency": "SELECT term, count(*) AS freq FROM (SELECT unnest(token_list) AS term FROM (SELECT DISTINCT sent_id, token_list FROM corpus_parsed_svo)) WHERE term IS NOT NULL GROUP BY term",
    "stats_verb_frequency": _SAL + "SELECT * FROM verb",
    "stats_object_frequency": TRIPLES + "SELECT obj AS term, count(*) AS freq FROM t WHERE obj IS NOT NULL GROUP BY obj",
    "stats_head_frequency": _SAL + "SELECT * FROM head",
    "stats_negation": TRIPLES + "SELECT lemma, count(*) AS n, count(*) FILTER (negated) AS n_negated, count(*) FILTER (obj IS NULL) AS n_without_object FROM t WHERE lemma IS NOT NULL GROUP BY lemma",
    "stats_verb_salience": _SAL + "SELECT * FROM vs",
    "stats_head_salience": _SAL + "SELECT * FROM hs",
    "stats_salient_verbs": _SAL + "SELECT * FROM vt",
    "stats_salient_heads": _SAL + "SELECT * FROM ht",
    "pairs_salient": _SAL + "SELECT * FROM pairs",
    "pairs_top": _SAL + "SELECT * FROM best",
    "pairs_sentences": _SAL + "SELECT lemma, head, score, sent_id FROM best LEFT JOIN (SELECT DISTINCT lemma, head, sent_id FROM pairs) USING (lemma, head)",
}
