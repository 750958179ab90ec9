"""Queries over verb-subject-object triples of the parsed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import clustering, models
from schemaloom.operators import triples as op
from schemaloom.plans import salience
from schemaloom.session import deliver_once, table

PLACES = ["predicate", "subject", "object"]


def weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = salience.triples(spark, d).where("lemma is not null and subj is not null and obj is not null")
    rows = rows.select(F.col("lemma").alias("predicate"), F.col("subj").alias("subject"), F.col("obj").alias("object"), F.lit(1).cast("bigint").alias("weight"))
    return op.merged(rows, PLACES, "weight")


def pruned(spark: SparkSession, d: str) -> DataFrame:
    return op.at_least(weighted(spark, d), "weight", 2)


def with_total(spark: SparkSession, d: str) -> DataFrame:
    """Each triple with its predicate's total weight, joined back to the rows."""
    rows = weighted(spark, d)
    # The total is aggregated first and joined: a window would put all rows of a frequent predicate in one task.
    return rows.join(op.merged(rows, ["predicate"], "weight").withColumnRenamed("weight", "total"), "predicate")


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return op.vocabularies(weighted(spark, d), PLACES, "weight")


def background_terms(spark: SparkSession, d: str) -> DataFrame:
    once = deliver_once(table(spark, d, "enwiki"), "sent_id", ["sent_id", "text"])
    return once.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term")).distinct()


def known(spark: SparkSession, d: str) -> DataFrame:
    """Triples whose predicate and object head are words of the background."""
    rows = weighted(spark, d).withColumn("head", salience.op.head_of(F.col("object")))
    return op.in_vocabulary(rows, ["predicate", "head"], background_terms(spark, d)).select(*PLACES, "head", "weight")


def all_known(spark: SparkSession, d: str) -> DataFrame:
    """Triples whose predicate and last words of subject and object all are words of the background that are no pronouns."""
    rows = weighted(spark, d).withColumn("subject_head", salience.op.head_of(F.col("subject"))).withColumn("object_head", salience.op.head_of(F.col("object")))
    words = op.without_pronouns(background_terms(spark, d))
    return op.in_vocabulary(rows, ["predicate", "subject_head", "object_head"], words).select(*PLACES, "weight")


def whispered_frames(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the triples that occur twice by vectors of their words (a stand-in encoder's)."""
    top = pruned(spark, d)
    words = op.vocabularies(top, PLACES, "weight").select(F.col("term").alias("word")).distinct()
    encoded = models.apply_model(words, "word", models.hashed_encoder(), "vector", "array<float>")
    return clustering.whispered_frames(top, PLACES, [encoded] * 3, 10)


def negated_only(spark: SparkSession, d: str) -> DataFrame:
    """(verb, object) pairs that occur negated and never otherwise."""
    rows = salience.triples(spark, d).where("lemma is not null and obj is not null")
    return rows.where("negated").select("lemma", "obj").subtract(rows.where("not negated").select("lemma", "obj"))


def both_ways(spark: SparkSession, d: str) -> DataFrame:
    rows = salience.triples(spark, d).where("lemma is not null and obj is not null")
    return rows.where("negated").select("lemma", "obj").intersect(rows.where("not negated").select("lemma", "obj"))


def shared_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that are both an object head and in the background, or a stop word."""
    heads = salience.head_frequency(spark, d).select("term")
    return heads.intersect(background_terms(spark, d)).union(salience.stop_words(spark, d)).distinct()


def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for every tenth of a triple's weight."""
    return op.repeated(weighted(spark, d), F.floor(F.col("weight") / 10)).select(*PLACES, "copy")


def top_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The two most frequent subjects of every predicate."""
    rows = op.merged(weighted(spark, d), ["predicate", "subject"], "weight")
    return op.largest(rows, "predicate", "weight", "subject", 2)


def frames(spark: SparkSession, d: str) -> DataFrame:
    return op.frame_members(weighted(spark, d), "predicate", {"subject": "subject", "object": "object"})


def telling_frames(spark: SparkSession, d: str) -> DataFrame:
    return op.telling_clusters(frames(spark, d), salience.stop_words(spark, d))


def frame_purity(spark: SparkSession, d: str) -> DataFrame:
    """Objects clustered by predicate, measured against objects clustered by subject."""
    return op.purity_scores(*frame_clusters(spark, d))


def frame_clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = weighted(spark, d).withColumn("element", F.concat_ws("|", *PLACES))
    return rows.select(F.col("predicate").alias("cluster"), "element"), rows.select(F.col("subject").alias("cluster"), "element")


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    """Verb-object edges as distances."""
    rows = op.merged(weighted(spark, d), ["predicate", "object"], "weight").select(F.col("predicate").alias("a"), F.col("object").alias("b"), F.col("weight").alias("w"))
    return op.inverted_weights(rows).withColumn("w", F.round("w", 6))


def report(spark: SparkSession, d: str) -> DataFrame:
    """A line of text a predicate: its totals and most frequent subject and object."""
    rows = weighted(spark, d)
    top = lambda c: op.largest(op.merged(rows, ["predicate", c], "weight"), "predicate", "weight", c, 1).select("predicate", F.col(c).alias(f"top_{c}"))
    total = rows.groupBy("predicate").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("n_triples"))
    joined = total.join(top("subject"), "predicate").join(top("object"), "predicate")
    return joined.select("predicate", F.format_string("%s (%d in %d): %s, %s", "predicate", "n", "n_triples", "top_subject", "top_object").alias("line"))


QUERIES = {
    "triples_weighted": weighted,
    "triples_pruned": pruned,
    "triples_with_total": with_total,
    "triples_vocabulary": vocabulary,
    "triples_known": known,
    "triples_all_known": all_known,
    "frames_whispered": whispered_frames,
    "triples_negated_only": negated_only,
    "triples_both_ways": both_ways,
    "triples_shared_words": shared_words,
    "triples_repeated": repeated_rows,
    "triples_top_subjects": top_subjects,
    "frames_members": frames,
    "frames_telling": telling_frames,
    "frames_purity": frame_purity,
    "triples_edges": event_edges,
    "triples_report": report,
}

_W = salience.TRIPLES + """, w AS (SELECT lemma AS predicate, subj AS subject, obj AS object, count(*) AS weight FROM t WHERE lemma IS NOT NULL AND subj IS NOT NULL AND obj IS NOT NULL GROUP BY ALL),
bgw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM (SELECT DISTINCT sent_id, text FROM enwiki)),
stop AS (SELECT DISTINCT lower(word) AS term FROM common_words),
mem AS (SELECT DISTINCT predicate AS cluster, 'subject' AS role, subject AS member FROM w UNION SELECT DISTINCT predicate, 'object', object FROM w)
"""
SQL = {
    "triples_weighted": _W + "SELECT * FROM w",
    "triples_pruned": _W + "SELECT * FROM w WHERE weight >= 2",
    "triples_with_total": _W + "SELECT *, sum(weight) OVER (PARTITION BY predicate)::BIGINT AS total FROM w",
    "triples_vocabulary": _W + "SELECT 'predicate' AS place, predicate AS term, sum(weight)::BIGINT AS n FROM w GROUP BY 2 UNION ALL SELECT 'subject', subject, sum(weight)::BIGINT FROM w GROUP BY 2 UNION ALL SELECT 'object', object, sum(weight)::BIGINT FROM w GROUP BY 2",
    "triples_known": _W + "SELECT *, string_split(object, ' ')[-1] AS head FROM w WHERE predicate IN (SELECT term FROM bgw) AND string_split(object, ' ')[-1] IN (SELECT term FROM bgw)",
    "triples_all_known": _W
    + f"""SELECT w.* FROM w WHERE predicate IN (SELECT term FROM kept) AND string_split(subject, ' ')[-1] IN (SELECT term FROM kept) AND string_split(object, ' ')[-1] IN (SELECT term FROM kept)""".replace(
        "SELECT w.*", ", kept AS (SELECT term FROM bgw WHERE term NOT IN (" + ", ".join(f"'{p}'" for p in op.PRONOUNS) + ")) SELECT w.*", 1
    ),
    "triples_negated_only": _W + "SELECT DISTINCT lemma, obj FROM t WHERE negated AND lemma IS NOT NULL AND obj IS NOT NULL EXCEPT SELECT lemma, obj FROM t WHERE NOT negated",
    "triples_both_ways": _W + "SELECT DISTINCT lemma, obj FROM t WHERE negated AND lemma IS NOT NULL AND obj IS NOT NULL INTERSECT SELECT lemma, obj FROM t WHERE NOT negated",
    "triples_shared_words": _W + "SELECT term FROM (SELECT DISTINCT string_split(obj, ' ')[-1] AS term FROM t WHERE obj IS NOT NULL INTERSECT SELECT term FROM bgw) UNION SELECT term FROM stop",
    "triples_repeated": _W + "SELECT predicate, subject, object, unnest(range(1, weight // 10 + 1))::INT AS copy FROM w WHERE weight >= 10",
    "triples_top_subjects": _W + "SELECT * FROM (SELECT predicate, subject, weight, row_number() OVER (PARTITION BY predicate ORDER BY weight DESC, subject)::INT AS place FROM (SELECT predicate, subject, sum(weight)::BIGINT AS weight FROM w GROUP BY ALL)) WHERE place <= 2",
    "frames_members": _W + "SELECT * FROM mem",
    "frames_telling": _W + "SELECT cluster, sum(n)::BIGINT AS n_members FROM (SELECT cluster, role, count(*) AS n FROM mem WHERE member NOT IN (SELECT term FROM stop) GROUP BY ALL) WHERE n > 1 GROUP BY cluster HAVING count(*) = 2",
    "frames_purity": _W + """, o AS (SELECT predicate AS p, subject AS g, count(*)::DOUBLE AS n FROM w GROUP BY ALL), k AS (SELECT count(*)::DOUBLE AS k FROM w),
x AS (SELECT (SELECT sum(m) FROM (SELECT max(n) AS m FROM o GROUP BY p HAVING sum(n) > 1)) / k AS pu, (SELECT sum(m) FROM (SELECT max(n) AS m FROM o GROUP BY g)) / k AS ipu FROM k)
SELECT round(pu, 6) AS purity, round(ipu, 6) AS inverse_purity, round(2 * pu * ipu / (pu + ipu), 6) AS f1 FROM x""",
    "triples_edges": _W + ", e AS (SELECT predicate AS a, object AS b, sum(weight)::DOUBLE AS w FROM w GROUP BY ALL) SELECT a, b, round((SELECT max(w) FROM e) / w, 6) AS w FROM e",
    "triples_report": _W + """, s AS (SELECT predicate, subject FROM w GROUP BY predicate, subject QUALIFY row_number() OVER (PARTITION BY predicate ORDER BY sum(weight) DESC, subject) = 1),
o AS (SELECT predicate, object FROM w GROUP BY predicate, object QUALIFY row_number() OVER (PARTITION BY predicate ORDER BY sum(weight) DESC, object) = 1),
n AS (SELECT predicate, sum(weight)::BIGINT AS n, count(*) AS k FROM w GROUP BY predicate)
SELECT predicate, predicate || ' (' || n || ' in ' || k || '): ' || subject || ', ' || object AS line FROM n JOIN s USING (predicate) JOIN o USING (predicate)""",
}
