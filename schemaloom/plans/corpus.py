"""Queries over raw text: cleaning, filters, sentence splitting, length statistics, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import corpus as op
from schemaloom.session import deliver_once, table


def records(spark: SparkSession, d: str) -> DataFrame:
    rows = deliver_once(table(spark, d, "corpus"), "sent_id", ["sent_id", "text", "dataset"])
    return rows.where("text is not null").withColumn("zh", F.col("dataset").endswith("_zh"))


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return op.with_filters(records(spark, d), "text", F.col("zh"))


def clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).where("not too_long and not too_numeric").select("sent_id", "text")


def filter_counters(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("too_long").alias("n_too_long"), F.count_if("too_numeric").alias("n_too_numeric"), F.max("length").alias("max_length"))


def zh_sentences(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where("zh").select("sent_id", F.posexplode(op.split_chinese(F.col("text"))).alias("sent_no", "sentence"))


def english_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    words = records(spark, d).where(F.col("dataset").endswith("_en")).select(F.explode(op.tokens(F.col("text"))).alias("word"))
    return op.abbreviations(words, "word")


def en_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by the abbreviations that the English texts themselves show; these are few, so they go along as an array."""
    known = english_abbreviations(spark, d).agg(F.array_sort(F.collect_set("term"))).scalar()
    rows = records(spark, d).where(F.col("dataset").endswith("_en")).withColumn("_known", known)
    return rows.select("sent_id", F.posexplode(op.split_english(F.col("text"), F.col("_known"))).alias("sent_no", "sentence"))


def simplified_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).withColumn("simplified", op.simplified(F.col("text")))
    return rows.where("simplified <> text").select("sent_id", "simplified")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return deliver_once(table(spark, d, "wiki_page"), "revid", ["revid", "title", "text"]).where("text is not null")


def title_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d)
    return rows.select("revid", op.repaired_text(F.col("text"), F.col("title"), op.is_chinese(F.col("text"))).alias("text"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of the pages with ``short``: they count as headings and leave the text."""
    rows = pages(spark, d).withColumn("zh", op.is_chinese(F.col("text")))
    rows = rows.select("revid", "zh", F.posexplode(F.split("text", "\n")).alias("par_no", "paragraph")).where("paragraph <> ''")
    return rows.withColumn("short", op.is_short(F.col("paragraph"), F.col("zh")))


def short_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs(spark, d).groupBy("short").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("paragraph")).alias("n_chars"))


def short_list(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs(spark, d).where("short").select("revid", "par_no", "paragraph")


def length_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).withColumn("length", op.text_length(F.col("text"), F.col("zh")))
    return rows.groupBy("dataset").agg(F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.round(F.avg("length"), 6).alias("mean_length"))


def common_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).withColumn("length", op.text_length(F.col("text"), F.col("zh")))
    return rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").limit(10)


def shuffled_sample(spark: SparkSession, d: str) -> DataFrame:
    return op.seeded_sample(records(spark, d).select("sent_id", "text"), "sent_id", 5000)


def consecutive_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages in the order of arrival without those that repeat the id of the page just before."""
    ids = table(spark, d, "wiki_page").where("id is not null and revid is not null").select(F.expr("try_cast(id as bigint)").alias("page"), "revid", "arrived_at").where("page is not null")
    return op.without_neighbours(ids, "page", [F.col("arrived_at"), F.col("revid")]).select("page", "revid")


QUERIES = {
    "corpus_clean": clean_corpus,
    "corpus_filter_counters": filter_counters,
    "corpus_zh_sentences": zh_sentences,
    "corpus_en_sentences": en_sentences,
    "corpus_abbreviations": english_abbreviations,
    "corpus_simplified": simplified_texts,
    "corpus_title_repair": title_repair,
    "corpus_short_list": short_list,
    "corpus_short_paragraphs": short_paragraphs,
    "corpus_length_statistics": length_statistics,
    "corpus_common_lengths": common_lengths,
    "corpus_shuffled_sample": shuffled_sample,
    "corpus_consecutive_pages": consecutive_pages,
}

_NUM = "[\\p{N}一二三四五六七八九十百千万亿零〇两]"
_SPACE = r"[^\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BAD = "[" + "".join(rf"\x{{{c}}}" for c in op.BAD_CODES) + "]"
_REC = "WITH rec AS (SELECT DISTINCT sent_id, text, dataset, dataset LIKE '%\\_zh' ESCAPE '\\' AS zh FROM corpus WHERE text IS NOT NULL)"
_FLAG = rf"""{_REC}, 
sized AS (SELECT sent_id, dataset, regexp_replace(text, '{_BAD}', '', 'g') AS clean, CASE WHEN zh THEN length(text) ELSE len(regexp_extract_all(text, '{_SPACE}+')) END AS length,
          len(regexp_extract_all(text, '{_NUM}')) / greatest(length(text), 1)::DOUBLE AS share FROM rec)
"""
_LEN = rf"""{_REC}, sized AS (SELECT dataset, CASE WHEN zh THEN length(text) ELSE len(regexp_extract_all(text, '{_SPACE}+')) END AS length FROM rec)
"""
_ZH = r"len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) * 2 > len(regexp_extract_all(text, '\p{L}'))"
_PAR = rf"""WITH page AS (SELECT DISTINCT revid, title, text, {_ZH} AS zh FROM wiki_page WHERE text IS NOT NULL),
part AS (SELECT revid, zh, string_split(text, chr(10)) AS lines FROM page),
par AS (SELECT revid, zh, (i - 1)::INT AS par_no, lines[i] AS paragraph FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM part) WHERE lines[i] <> ''),
short AS (SELECT *, CASE WHEN zh THEN length(paragraph) ELSE len(regexp_extract_all(paragraph, '{_SPACE}+')) END <= 5 AS short FROM par)
"""
_ABB = rf"""WITH rec AS (SELECT DISTINCT sent_id, text FROM corpus WHERE text IS NOT NULL AND dataset LIKE '%\_en' ESCAPE '\'),
tok AS (SELECT sent_id, regexp_extract_all(text, '{_SPACE}+') AS w FROM rec), word AS (SELECT unnest(w) AS w FROM tok),
term AS (SELECT regexp_replace(lower(w), '\.$', '') AS term, ends_with(w, '.')::INT AS d FROM word),
ct AS (SELECT term, count(*)::DOUBLE AS n, sum(d)::DOUBLE AS k, length(replace(term, '.', '')) AS l, length(term) - length(replace(term, '.', '')) + 1 AS stops FROM term WHERE regexp_full_match(term, '\p{{L}}[\p{{L}}.]*') GROUP BY term),
p AS (SELECT sum(k) / sum(n) AS p FROM ct),
ab AS (SELECT term, round(-2 * ((k * ln(p) + (n - k) * ln(1 - p)) - (k * ln(0.99::DOUBLE) + (n - k) * ln(1 - 0.99::DOUBLE))) * exp(-l::DOUBLE) * stops * pow(l::DOUBLE, -(n - k)), 6) AS score FROM ct, p WHERE k >= 5),
abb AS (SELECT * FROM ab WHERE score >= 0.3)
"""

SQL = {
    "corpus_clean": _FLAG + "SELECT sent_id, clean AS text FROM sized WHERE length < 256 AND share <= 0.25",
    "corpus_filter_counters": _FLAG + "SELECT dataset, count(*) AS n, count(*) FILTER (length >= 256) AS n_too_long, count(*) FILTER (share > 0.25) AS n_too_numeric, max(length)::INT AS max_length FROM sized GROUP BY dataset",
    "corpus_zh_sentences": _REC + r""", s AS (SELECT sent_id, regexp_extract_all(text, '(?s).*?(?:。|[!?！？]+)') AS l FROM rec WHERE zh)
SELECT sent_id, (i - 1)::INT AS sent_no, l[i] AS sentence FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM s)""",
    "corpus_abbreviations": _ABB + "SELECT * FROM abb",
    "corpus_en_sentences": _ABB
    + r""", it AS (SELECT sent_id, w, unnest(range(1, len(w) + 1)) AS i FROM tok),
e AS (SELECT sent_id, w, i FROM it WHERE i = len(w) OR (regexp_matches(w[i], '[.!?]["''”’)\]]*$')
  AND NOT (ends_with(w[i], '.') AND (regexp_replace(lower(w[i]), '\.$|^["''“‘(\[]+', '', 'g') IN (SELECT term FROM abb) OR regexp_matches(w[i], '^["''“‘(\[]*\p{Lu}\.$')))
  AND NOT regexp_matches(w[i + 1], '^\p{Ll}'))),
s AS (SELECT *, row_number() OVER r - 1 AS no, coalesce(lag(i) OVER r, 0) AS prev FROM e WINDOW r AS (PARTITION BY sent_id ORDER BY i))
SELECT sent_id, no::INT AS sent_no, array_to_string(w[prev + 1:i], ' ') AS sentence FROM s""",
    "corpus_simplified": _REC + "".join(f", s AS (SELECT sent_id, text, translate(text, '{a}', '{b}') AS simplified FROM rec) SELECT sent_id, simplified FROM s WHERE simplified <> text" for a, b in op.SIMPLIFIED.items()),
    "corpus_title_repair": rf"""WITH page AS (SELECT DISTINCT revid, title, text, {_ZH} AS zh, regexp_replace(text, '^[\p{{Z}}\s]+', '') AS bare FROM wiki_page WHERE text IS NOT NULL)
SELECT revid, CASE WHEN zh AND starts_with(bare, '是') AND title IS NOT NULL AND left(text, 2) <> left(title, 2) THEN title || text
WHEN NOT zh AND regexp_matches(bare, '^(is|was|were|are) ') THEN concat_ws(' ', trim(title), bare) ELSE text END AS text FROM page""",
    "corpus_short_paragraphs": _PAR + "SELECT short, count(*) AS n, sum(length(paragraph))::BIGINT AS n_chars FROM short GROUP BY 1",
    "corpus_short_list": _PAR + "SELECT revid, par_no, paragraph FROM short WHERE short",
    "corpus_length_statistics": _LEN + "SELECT dataset, min(length)::INT AS min_length, max(length)::INT AS max_length, round(avg(length), 6) AS mean_length FROM sized GROUP BY dataset",
    "corpus_common_lengths": _LEN + "SELECT length::INT AS length, count(*) AS n FROM sized GROUP BY length ORDER BY n DESC, length LIMIT 10",
    "corpus_shuffled_sample": _REC + "SELECT sent_id, text FROM rec ORDER BY md5('1234-' || sent_id::VARCHAR), sent_id LIMIT 5000",
    "corpus_consecutive_pages": """WITH p AS (SELECT try_cast(id AS BIGINT) AS page, revid, arrived_at FROM wiki_page WHERE id IS NOT NULL AND revid IS NOT NULL AND try_cast(id AS BIGINT) IS NOT NULL)
SELECT page, revid FROM (SELECT *, lag(page) OVER (ORDER BY arrived_at, revid) AS last FROM p) WHERE last IS DISTINCT FROM page""",
}
