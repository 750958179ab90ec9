"""Queries of the general data-processing problems (heavy keys, nested records) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.svo import triples_once
from schemaloom.operators.nested import linked_arguments, node_table, shred
from schemaloom.operators.range_runs import heavy_key_mode
from schemaloom.session import deliver_once, table


def lemma_objects(spark: SparkSession, d: str) -> DataFrame:
    """``lemma, obj`` of every triple with both, each record once."""
    return triples_once(table(spark, d, "corpus_parsed_svo")).where("lemma is not null and obj is not null").select("lemma", "obj")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_key_mode(lemma_objects(spark, d), "lemma", "obj").select(F.col("key").alias("lemma"), F.col("top").alias("obj"))


def p1_lemma_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per lemma: triples, distinct objects, most frequent object and its count."""
    return heavy_key_mode(lemma_objects(spark, d), "lemma", "obj").select(
        F.col("key").alias("lemma"), "n_rows", "n_values", F.col("top").alias("obj"), "n_top"
    )


def oneie_nodes(spark: SparkSession, d: str) -> DataFrame:
    gold = deliver_once(table(spark, d, "train_oneie"), "inst_id", ["inst_id", "event_mentions", "entity_mentions"])
    return shred(gold.withColumn("_record", record_of("event_mentions", "entity_mentions")), "_record")


def event_list_nodes(spark: SparkSession, d: str) -> DataFrame:
    gold = deliver_once(table(spark, d, "train_event_list"), "inst_id", ["inst_id", "event_list"])
    return shred(gold.withColumn("_record", record_of("event_list")), "_record")


def record_of(*columns: str):
    """The record's id; without one, a name made of its content."""
    return F.coalesce(F.col("inst_id").cast("string"), F.concat(F.lit("#"), F.md5(F.to_json(F.struct(*columns)))))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    english = linked_arguments(oneie_nodes(spark, d), "event_mentions", "arguments", "entity_mentions").withColumn("src", F.lit("train_oneie"))
    chinese = linked_arguments(event_list_nodes(spark, d), "event_list", "arguments").withColumn("src", F.lit("train_event_list"))
    wanted = ["src", F.expr("try_cast(record as bigint)").alias("inst_id"), "event_no", "arg_no", "ent_no"]
    return english.select(*wanted).unionByName(chinese.select(*wanted))


def p3_events(spark: SparkSession, d: str) -> DataFrame:
    """The event table of both sources, with the interval labels that link it to its record and arguments."""
    english = node_table(oneie_nodes(spark, d), "event_mentions").where("present").select(
        F.lit("train_oneie").alias("src"), "record", "pre", "post", "pos", "event_type", F.col("trigger.text").alias("trigger"))
    chinese = node_table(event_list_nodes(spark, d), "event_list").where("present").select(
        F.lit("train_event_list").alias("src"), "record", "pre", "post", "pos", "event_type", "trigger")
    return english.unionByName(chinese)


def p3_arguments(spark: SparkSession, d: str) -> DataFrame:
    """The argument table of both sources: labels, places of event, argument and entity, role and text."""
    english = linked_arguments(oneie_nodes(spark, d), "event_mentions", "arguments", "entity_mentions").withColumn("src", F.lit("train_oneie"))
    chinese = linked_arguments(event_list_nodes(spark, d), "event_list", "arguments").withColumn("src", F.lit("train_event_list")).withColumnRenamed("argument", "text")
    kept = ["src", "record", "pre", "post", "event_no", "arg_no", "ent_no", "role", "text"]
    return english.select(*kept).unionByName(chinese.select(*kept))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = node_table(oneie_nodes(spark, d), "entity_mentions").where("present")
    return rows.select("record", "pre", "post", "pos", F.col("id").alias("ent_id"), "mention_type", F.col("start").alias("ent_start"), F.col("end").alias("ent_end"))


QUERIES = {
    "p1_found": p1_found,
    "p1_lemma_profile": p1_lemma_profile,
    "p3_found": p3_found,
    "p3_events": p3_events,
    "p3_entities": p3_entities,
    "p3_arguments": p3_arguments,
}

B = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_PAIRS = rf"""
WITH once AS (SELECT DISTINCT sent_id, svos FROM corpus_parsed_svo),
triple AS (SELECT unnest(svos) AS s FROM once),
clean AS (
  SELECT lower(regexp_replace(regexp_replace(s.verb.lemma, '^{B}+|{B}+$', '', 'g'), '^!{B}*', '')) AS lemma,
         lower(trim(regexp_replace(s.obj.text, '{B}+', ' ', 'g'))) AS obj
  FROM triple),
pair AS (SELECT lemma, obj, count(*) AS n FROM clean WHERE lemma <> '' AND obj <> '' GROUP BY ALL)
"""

# Nodes are numbered in the order of a depth-first walk: the record, its events each followed by its arguments, its entities.
_NODES = rf"""
WITH one AS (SELECT DISTINCT inst_id::VARCHAR AS record, event_mentions, entity_mentions FROM train_oneie), zh AS (SELECT DISTINCT inst_id::VARCHAR AS record, event_list FROM train_event_list),
ev AS (SELECT record, i - 1 AS pos, event_mentions[i] AS e, coalesce(len(event_mentions[i].arguments), 0) AS k FROM (SELECT *, unnest(range(1, len(event_mentions) + 1)) AS i FROM one)),
evn AS (SELECT *, 1 + coalesce(sum(1 + k) OVER (PARTITION BY record ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre FROM ev),
zev AS (SELECT record, i - 1 AS pos, event_list[i] AS e, coalesce(len(event_list[i].arguments), 0) AS k FROM (SELECT *, unnest(range(1, len(event_list) + 1)) AS i FROM zh)),
zevn AS (SELECT *, 1 + coalesce(sum(1 + k) OVER (PARTITION BY record ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre FROM zev),
ent AS (SELECT record, i - 1 AS pos, entity_mentions[i] AS m, lower(regexp_replace(entity_mentions[i].id, '^{B}+|{B}+$', '', 'g')) AS key FROM (SELECT *, unnest(range(1, len(entity_mentions) + 1)) AS i FROM one)),
fe AS (SELECT record, key, min(pos) AS ent_no FROM ent WHERE key IS NOT NULL GROUP BY ALL)
"""

SQL = {
    "p3_events": _NODES
    + """SELECT 'train_oneie' AS src, record, pre, pre + k - 1 AS post, pos::INT AS pos, e.event_type AS event_type, e.trigger.text AS trigger FROM evn WHERE e IS NOT NULL
UNION ALL SELECT 'train_event_list', record, pre, pre + k - 1, pos::INT, e.event_type, e.trigger FROM zevn WHERE e IS NOT NULL""",
    "p3_arguments": _NODES
    + rf""", a AS (SELECT record, pos AS event_no, j - 1 AS arg_no, pre + j AS pre, e.arguments[j] AS a FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM evn WHERE e IS NOT NULL) WHERE e.arguments[j] IS NOT NULL),
z AS (SELECT record, pos AS event_no, j - 1 AS arg_no, pre + j AS pre, e.arguments[j] AS a FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM zevn WHERE e IS NOT NULL) WHERE e.arguments[j] IS NOT NULL)
SELECT 'train_oneie' AS src, a.record, pre, pre - 2 AS post, event_no::INT AS event_no, arg_no::INT AS arg_no, coalesce(ent_no, -1)::INT AS ent_no, a.role AS role, a.text AS text
FROM a LEFT JOIN fe ON fe.record = a.record AND fe.key = lower(regexp_replace(a.entity_id, '^{B}+|{B}+$', '', 'g'))
UNION ALL SELECT 'train_event_list', record, pre, pre - 2, event_no::INT, arg_no::INT, -1, a.role, a.argument FROM z""",
    "p3_entities": _NODES
    + """, total AS (SELECT record, sum(1 + k)::BIGINT AS n FROM ev GROUP BY record)
SELECT record, 1 + coalesce(n, 0) + pos AS pre, coalesce(n, 0) + pos AS post, pos::INT AS pos, m.id AS ent_id, m.mention_type AS mention_type, m."start" AS ent_start, m."end" AS ent_end FROM ent LEFT JOIN total USING (record) WHERE m IS NOT NULL""",
    "p1_found": _PAIRS
    + "SELECT lemma, obj FROM pair QUALIFY row_number() OVER (PARTITION BY lemma ORDER BY n DESC, obj) = 1",
    "p1_lemma_profile": _PAIRS
    + """, top AS (SELECT lemma, obj, n FROM pair QUALIFY row_number() OVER (PARTITION BY lemma ORDER BY n DESC, obj) = 1)
SELECT lemma, CAST(sum(pair.n) AS BIGINT) AS n_rows, count(*) AS n_values, any_value(top.obj) AS obj, any_value(top.n) AS n_top
FROM pair JOIN top USING (lemma) GROUP BY lemma""",
    "p3_found": rf"""
WITH one AS (SELECT DISTINCT inst_id, event_mentions, entity_mentions FROM train_oneie),
ev AS (SELECT inst_id, entity_mentions, i - 1 AS event_no, event_mentions[i].arguments AS args
       FROM (SELECT *, unnest(range(1, len(event_mentions) + 1)) AS i FROM one) WHERE event_mentions[i] IS NOT NULL),
arg AS (SELECT inst_id, entity_mentions, event_no, j - 1 AS arg_no, args[j] AS a
        FROM (SELECT *, unnest(range(1, len(args) + 1)) AS j FROM ev) WHERE args[j] IS NOT NULL),
ent AS (SELECT inst_id, k - 1 AS ent_no, lower(regexp_replace(entity_mentions[k].id, '^{B}+|{B}+$', '', 'g')) AS id
        FROM (SELECT *, unnest(range(1, len(entity_mentions) + 1)) AS k FROM one)),
first_ent AS (SELECT inst_id, id, min(ent_no) AS ent_no FROM ent WHERE id IS NOT NULL GROUP BY ALL),
zh AS (SELECT DISTINCT inst_id, event_list FROM train_event_list),
zev AS (SELECT inst_id, i - 1 AS event_no, event_list[i].arguments AS args
        FROM (SELECT *, unnest(range(1, len(event_list) + 1)) AS i FROM zh) WHERE event_list[i] IS NOT NULL),
zarg AS (SELECT inst_id, event_no, j - 1 AS arg_no FROM (SELECT *, unnest(range(1, len(args) + 1)) AS j FROM zev) WHERE args[j] IS NOT NULL)
SELECT 'train_oneie' AS src, arg.inst_id, CAST(event_no AS INT) AS event_no, CAST(arg_no AS INT) AS arg_no, CAST(coalesce(f.ent_no, -1) AS INT) AS ent_no
FROM arg LEFT JOIN first_ent f ON f.inst_id = arg.inst_id AND f.id = lower(regexp_replace(a.entity_id, '^{B}+|{B}+$', '', 'g'))
UNION ALL
SELECT 'train_event_list', inst_id, CAST(event_no AS INT), CAST(arg_no AS INT), -1 FROM zarg""",
}
