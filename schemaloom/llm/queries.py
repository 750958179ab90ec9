"""Queries of the text problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.canonical import canonical, lookalike_classes, lookalike_pairs
from schemaloom.functions.svo import triples_once
from schemaloom.llm import langid, mixing, packing, sentences, termfreq
from schemaloom.operators.range_runs import combine_map_side
from schemaloom.llm.quality import TAILS, text_quality
from schemaloom.llm.reservoir import rows_of_sample, sample_records
from schemaloom.session import deliver_once, spread, table, with_checkpoints


def p2_quality(spark: SparkSession, d: str) -> DataFrame:
    """Every record's statistics, z-scores and verdict."""
    rows = text_quality(spread(table(spark, d, "corpus").select("sent_id", "text")), "sent_id", "text", table(spark, d, "common_words"))
    return rows.select("sent_id", "lang_guess", "n_words", *TAILS, *(f"z_{c}" for c in TAILS), "tail_score", "is_prose")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = text_quality(spread(table(spark, d, "corpus").select("sent_id", "text")), "sent_id", "text", table(spark, d, "common_words"))
    return rows.where(~F.col("is_prose")).select("sent_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence ends of the wiki pages and of the corpus records that are prose.

    Each record counts once, as evidence too; its texts are written once, and so are the verdicts of p2.
    """
    with_checkpoints(spark)
    pages = table(spark, d, "wiki_page").select("revid", F.md5("text").alias("_digest"), "text")
    pages = deliver_once(pages, "revid", ["_digest", "revid", "text"]).select(F.lit("wiki_page").alias("src"), F.col("revid").alias("rec_id"), "text")
    records = corpus_texts(spark, d).select(F.lit("corpus").alias("src"), F.col("sent_id").cast("string").alias("rec_id"), "text")
    texts = spread(pages.unionByName(records).where("text is not null").checkpoint())
    junk = p2_found(spark, d).select(F.lit("corpus").alias("src"), F.col("sent_id").cast("string").alias("rec_id")).checkpoint()
    return sentences.split_sentences(texts.join(junk, ["src", "rec_id"], "left_anti"), ["src", "rec_id"], "text", texts.select("text"))


def corpus_texts(spark: SparkSession, d: str) -> DataFrame:
    """``sent_id, text`` of every record once; of deliveries that differ, the one whose text's digest sorts first."""
    rows = table(spark, d, "corpus").select("sent_id", F.md5("text").alias("_digest"), "text")
    return deliver_once(rows, "sent_id", ["_digest", "sent_id", "text"]).drop("_digest")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike_pairs(table(spark, d, "corpus").where("sent_id is not null"), "sent_id", "text")
    return pairs.select(F.col("id_a").alias("sent_id_a"), F.col("id_b").alias("sent_id_b"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a record that has a look-alike: its class, its spelling and its number of partners."""
    return lookalike_classes(table(spark, d, "corpus").where("sent_id is not null"), "sent_id", "text").withColumnRenamed("id", "sent_id")


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every record with the consistent form of its text."""
    return canonical(table(spark, d, "corpus").select("sent_id", "text"), "text")


def p6_sample(spark: SparkSession, d: str, size: int = 1000) -> DataFrame:
    """``size`` records of each collection, every record (sent_id) with the same chance."""

    def drawn(name: str, seed: int) -> DataFrame:
        rows = table(spark, d, name).select("sent_id", "text", "piece_no")
        found = rows_of_sample(rows, "sent_id", sample_records(rows, "sent_id", size, seed))
        return deliver_once(found, "sent_id", ["sent_id", "text", "piece_no", "n_population"]).select(F.lit(name).alias("src"), "sent_id", "piece_no", "text", "n_population")

    return drawn("enwiki", 17).unionByName(drawn("corpus", 18))


def enwiki_terms(spark: SparkSession, d: str) -> DataFrame:
    once = deliver_once(table(spark, d, "enwiki"), "sent_id", ["sent_id", "text"]).where("sent_id is not null")
    words = once.select("sent_id", F.explode(termfreq.words_of(F.col("text"))).alias("term"))
    return combine_map_side(words, "term", "sent_id")


def lemma_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = triples_once(table(spark, d, "corpus_parsed_svo")).where("lemma is not null and sent_id is not null")
    return combine_map_side(rows.select("lemma", F.col("sent_id").cast("bigint").alias("sent_id")), "lemma", "sent_id")


def p7_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """``src, term, n_occurrences, n_records, mark`` of every term."""
    words = table(spark, d, "enwiki").agg(F.count_distinct("sent_id").alias("n_all"))
    parsed = table(spark, d, "corpus_parsed_svo").where(F.exists("svos", lambda s: s.isNotNull()))
    triples = parsed.agg(F.count_distinct("sent_id").alias("n_all"))
    english = termfreq.marked(termfreq.term_frequencies(enwiki_terms(spark, d)), words).withColumn("src", F.lit("enwiki"))
    lemmas = termfreq.marked(termfreq.term_frequencies(lemma_terms(spark, d)), triples).withColumn("src", F.lit("corpus_parsed_svo"))
    return english.unionByName(lemmas).select("src", "term", "n_occurrences", "n_records", "mark")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_frequencies(spark, d).where("mark is not null").select("src", "term", "mark")


def sized_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents once each with their size in byte tokens; the stored counts are unreliable."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    return deliver_once(rows, "doc_id", ["doc_id", "source", "size"])


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """The contents of every container: ``pack_name, bin, doc_id, piece, n_pieces, length``."""
    contents, _ = packing.pack(sized_documents(spark, d), "doc_id", "size", table(spark, d, "pack_spec"))
    return contents.withColumnRenamed("item", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of container: containers, used space, share left empty, and the least number that could do."""
    contents, _ = packing.pack(sized_documents(spark, d), "doc_id", "size", table(spark, d, "pack_spec"))
    bins = packing.bin_fill(contents, table(spark, d, "pack_spec"))
    return bins.groupBy("pack_name", "capacity").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("used"), F.ceil(F.sum("used") / F.col("capacity")).alias("least_bins"),
        F.round(F.sum("slack") / (F.count(F.lit(1)) * F.col("capacity")), 6).alias("empty_share"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose first piece has its container and is not the only one."""
    return p8_packed(spark, d).where("n_pieces > 1 and piece = 0 and bin >= 0").select("pack_name", "doc_id")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture in training order."""
    mixed = mixing.mixture(sized_documents(spark, d), "doc_id", "source", "size", table(spark, d, "mix_target"))
    return mixing.in_training_order(mixed).withColumn("position", F.round("position", 9)).withColumnRenamed("item", "doc_id")


def reached(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = sized_documents(spark, d), table(spark, d, "mix_target")
    mixed = mixing.mixture(documents, "doc_id", "source", "size", targets)
    return mixing.reached_shares(documents, "source", "size", targets, mixed)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return reached(spark, d).drop("wanted_size", "ended_size")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the mixture leaves short of their target at the end of the curriculum, and that no mixture could bring there."""
    short = F.col("ended_size").isNull() | (F.col("ended_size") < F.col("wanted_size"))
    return reached(spark, d).where(short & ~F.col("reachable")).select("source")


def identified(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, label, lang, confidence, languages, segments``, each document once; of deliveries that differ, the one
    whose text's digest sorts first. Only results are shuffled, not texts."""
    documents = spread(table(spark, d, "documents").select("doc_id", "text", "lang"))
    model = langid.fit_documents(documents, "doc_id", "text", "lang")
    labelled = documents.select("doc_id", F.md5("text").alias("_digest"), "text", langid.label_language(F.col("lang")).alias("label"))
    rows = langid.identify(labelled, ["doc_id", "_digest", "label"], "text", model)
    return deliver_once(rows, "doc_id", ["_digest", *(c for c in rows.columns if c != "_digest")]).drop("_digest")


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's language, confidence, and all languages it has whole sentences in."""
    return identified(spark, d).select("doc_id", "label", "lang", F.round("confidence", 4).alias("confidence"), F.array_join("languages", ",").alias("languages"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each segment of one language of the documents that mix several."""
    rows = identified(spark, d).where(F.size("languages") > 1).select("doc_id", F.inline("segments"))
    return rows.select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "lang", F.round("confidence", 4).alias("confidence"), "sure")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    rows = identified(spark, d).where("lang is not null")
    wrong = F.col("label").isNull() | ~F.array_contains("languages", F.col("label")) | (F.size("languages") > 1)
    return rows.where(wrong).select("doc_id", F.explode("languages").alias("lang"))


QUERIES = {
    "p2_found": p2_found,
    "p2_quality": p2_quality,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p5_canonical": p5_canonical,
    "p6_sample": p6_sample,
    "p7_found": p7_found,
    "p7_frequencies": p7_frequencies,
    "p8_found": p8_found,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_documents": p10_documents,
    "p10_segments": p10_segments,
}

B = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_TERMS = rf"""
WITH words AS (SELECT sent_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS term FROM (SELECT DISTINCT sent_id, text FROM enwiki)),
triple AS (SELECT sent_id, unnest(svos) AS s FROM (SELECT DISTINCT sent_id, svos FROM corpus_parsed_svo)),
lemmas AS (SELECT sent_id, lower(regexp_replace(regexp_replace(s.verb.lemma, '^{B}+|{B}+$', '', 'g'), '^!{B}*', '')) AS term FROM triple),
freq AS (
  SELECT 'enwiki' AS src, term, count(*) AS n_occurrences, count(DISTINCT sent_id) AS n_records,
         (SELECT count(DISTINCT sent_id) FROM enwiki) AS n_all FROM words GROUP BY term
  UNION ALL
  SELECT 'corpus_parsed_svo', term, count(*), count(DISTINCT sent_id),
         (SELECT count(DISTINCT sent_id) FROM triple WHERE s IS NOT NULL) FROM lemmas WHERE term <> '' GROUP BY term),
marked AS (SELECT *, CASE WHEN n_records > 0.1::DOUBLE * n_all THEN 'common' WHEN n_records <= 2 THEN 'rare' END AS mark FROM freq)
"""
_SIZES = rf"""
WITH doc AS (SELECT doc_id, lower(regexp_replace(source, '^{B}+|{B}+$', '', 'g')) AS source, coalesce(octet_length(encode(text)), 0) AS size
             FROM (SELECT DISTINCT doc_id, source, text FROM documents))
"""

_MIX = (
    _SIZES
    + rf""", own AS (SELECT source, sum(size)::BIGINT AS own_size FROM doc WHERE source IS NOT NULL GROUP BY source), tot AS (SELECT sum(size)::BIGINT AS total_size FROM doc),
tgt AS (SELECT lower(regexp_replace(source, '^{B}+|{B}+$', '', 'g')) AS source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_target WHERE source IS NOT NULL GROUP BY 1),
share AS (SELECT source, target_share, max_repeats, coalesce(own_size, 0)::BIGINT AS own_size, total_size, coalesce(target_share, 0) * total_size AS wanted,
  (coalesce(max_repeats, 0) * coalesce(own_size, 0))::BIGINT AS possible FROM tgt LEFT JOIN own USING (source) CROSS JOIN tot),
begun AS (SELECT doc_id, source, size, own_size, least(wanted, possible::DOUBLE) AS demand,
  coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('5-' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM doc JOIN share USING (source) WHERE size > 0),
use AS (SELECT *, unnest(range(0, ceil((demand - start) / own_size)::BIGINT)) AS epoch FROM begun WHERE start < demand),
due AS (SELECT *, start + epoch * own_size AS offs, (start + epoch * own_size) / demand AS f, demand > own_size AS late FROM use),
mixed AS (SELECT doc_id, source, epoch::INT AS epoch, size::BIGINT AS size, offs AS "offset", round(CASE
  WHEN late AND f < 0.375 THEN sqrt(0.25 + 2 * f) - 0.5 WHEN late THEN 0.5 + sqrt(1.0 + 2 * (f - 0.375)) - 1.0
  WHEN f < 0.625 THEN 1.5 - sqrt(2.25 - 2 * f) ELSE 0.5 + 1.0 - sqrt(1.0 - 2 * (f - 0.625)) END, 9) AS position FROM due)
"""
)

SQL: dict[str, str] = {
    "p9_mixture": _MIX + "SELECT * FROM mixed",
    "p9_shares": _MIX
    + """, given AS (SELECT source, count(*) AS n_uses, sum(size)::BIGINT AS used_size FROM mixed GROUP BY source)
SELECT source, target_share, max_repeats, own_size, total_size, coalesce(n_uses, 0) AS n_uses, coalesce(used_size, 0)::BIGINT AS used_size,
round(coalesce(used_size, 0) / nullif(sum(used_size) OVER (), 0), 6) AS reached_share, round(coalesce(used_size, 0) / nullif(total_size, 0), 6) AS share_of_total, possible >= wanted AS reachable
FROM share LEFT JOIN given USING (source)""",
    "p7_found": _TERMS + "SELECT src, term, mark FROM marked WHERE mark IS NOT NULL",
    "p7_frequencies": _TERMS + "SELECT src, term, n_occurrences, n_records, mark FROM marked",
    "p8_found": _SIZES + "SELECT pack_name, doc_id FROM doc, pack_spec WHERE size > capacity",
    "p9_found": _SIZES
    + """SELECT source FROM (
  SELECT t.source, target_share * (SELECT sum(size) FROM doc) AS wanted, max_repeats * coalesce((SELECT sum(size) FROM doc d WHERE d.source = t.source), 0) AS possible
  FROM mix_target t) WHERE possible < wanted""",
}
