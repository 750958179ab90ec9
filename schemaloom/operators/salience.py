"""Frequencies, salience of terms, salient (verb, object head) pairs and the sentences behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.operators.ranking import ranked
from schemaloom.session import with_checkpoints

BACKGROUND_SIZE = 1e8


def term_counts(terms: DataFrame, term: str) -> DataFrame:
    return terms.where(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("freq"))


def salience(local: Column, background: Column) -> Column:
    """(1 + log10(local)^2) * log10(1e8 / background); -1 for a term the background doesn't know."""
    known = (1 + F.pow(F.log10(local), 2.0)) * F.log10(BACKGROUND_SIZE / background)
    return F.coalesce(known, F.lit(-1.0))


def with_salience(local: DataFrame, background: DataFrame) -> DataFrame:
    """``term, freq, salience`` of every local term."""
    known = background.select("term", F.col("freq").alias("background"))
    return local.join(known, "term", "left").select("term", "freq", F.round(salience(F.col("freq"), F.col("background")), 4).alias("salience"))


def top_terms(scored: DataFrame, stop: DataFrame, ratio: float, min_freq: int) -> DataFrame:
    """The ``int(n * ratio)`` most salient terms, of n in all, that are no stop words; then those of at least ``min_freq``.

    Stop words don't use up the budget. A budget of 0 takes all terms. The most salient come first.
    """
    with_checkpoints(scored.sparkSession)
    scored = scored.checkpoint()  # a row a term: counted, numbered and filtered by what follows
    budget = int(scored.count() * ratio)
    kept = scored.join(stop.select("term"), "term", "left_anti")
    # The budget is a share of the vocabulary, so the best are numbered in place and not gathered.
    best = ranked(kept, [], [F.desc("salience"), F.col("term")]).where(F.col("rank") <= budget).drop("rank") if budget else kept
    return best.where(F.col("freq") >= min_freq).orderBy(F.desc("salience"), "term")


def head_of(phrase: Column) -> Column:
    """The last word of a phrase stands for its syntactic head; a parser's table can replace it."""
    return F.element_at(F.split(phrase, " "), -1)


def regular_phrase(phrase: Column) -> Column:
    """Whether blanks in the phrase are single and nowhere outside."""
    return phrase == F.array_join(F.filter(F.split(phrase, r"\s+"), lambda w: w != ""), " ")


def salient_pairs(triples: DataFrame, verbs: DataFrame, heads: DataFrame) -> DataFrame:
    """``sent_id, lemma, head, score`` of triples whose verb and object head are salient; score is the product."""
    v = verbs.select(F.col("term").alias("lemma"), F.col("salience").alias("_v"))
    h = heads.select(F.col("term").alias("head"), F.col("salience").alias("_h"))
    rows = triples.where("lemma is not null and obj is not null").withColumn("head", head_of(F.col("obj")))
    return rows.join(v, "lemma").join(h, "head").select("sent_id", "lemma", "head", F.round(F.col("_v") * F.col("_h"), 4).alias("score"))


def top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` distinct pairs of the highest score; with ``n`` 0 all, in ascending order of score."""
    distinct = pairs.select("lemma", "head", "score").distinct()
    return distinct.orderBy(F.desc("score"), "lemma", "head").limit(n) if n else distinct.orderBy("score", "lemma", "head")
