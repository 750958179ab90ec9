"""Queries of gold mentions, their senses and the features of predicate-object tuples.

Parsed and gold records are matched by id. No masked model runs here: a mention's expansions are the other words of its
sentence in order, a sense is a gold event type of the verb, and a mention's vector is the one with the sentence's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaloom.functions.svo import lemma_of, phrase_of
from schemaloom.operators import mentions as op
from schemaloom.operators.salience import head_of
from schemaloom.operators.vectors import mean_vectors, packed
from schemaloom.session import deliver_once, table


def triples(spark: SparkSession, d: str) -> DataFrame:
    once = deliver_once(table(spark, d, "corpus_parsed_svo"), "sent_id", ["sent_id", "svos"]).where("sent_id is not null")
    rows = once.select(F.col("sent_id").cast("bigint").alias("sent_id"), F.posexplode("svos").alias("svo_no", "s")).where("s is not null")
    return rows.select("sent_id", "svo_no", lemma_of(F.col("s.verb.lemma")).alias("lemma"), F.col("s.verb.idx").alias("verb_index"), phrase_of(F.col("s.obj.text")).alias("obj"), F.col("s.obj.idx").alias("obj_idx")).where("lemma is not null and obj is not null")


def gold(spark: SparkSession, d: str) -> DataFrame:
    once = deliver_once(table(spark, d, "train_oneie"), "inst_id", ["inst_id", "event_mentions", "entity_mentions"])
    return once.where("inst_id is not null").withColumnRenamed("inst_id", "sent_id")


def events(spark: SparkSession, d: str) -> DataFrame:
    rows = gold(spark, d).select("sent_id", F.posexplode("event_mentions").alias("event_no", "e")).where("e.event_type is not null and e.trigger is not null")
    return rows.select("sent_id", "event_no", "e.event_type", F.col("e.trigger.start").alias("trigger_start"), F.col("e.trigger.end").alias("trigger_end"), "e.arguments")


def arguments(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("sent_id", F.explode("arguments").alias("a")).select("sent_id", F.col("a.entity_id").alias("entity_id")).where("entity_id is not null")


def entities(spark: SparkSession, d: str) -> DataFrame:
    rows = gold(spark, d).select("sent_id", F.explode("entity_mentions").alias("m")).where("m.id is not null")
    return rows.select("sent_id", F.col("m.id").alias("entity_id"), F.col("m.mention_type").alias("kind"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def trigger_types(spark: SparkSession, d: str) -> DataFrame:
    return op.matched_triggers(triples(spark, d), events(spark, d))


def object_matches(spark: SparkSession, d: str) -> DataFrame:
    return op.matched_objects(triples(spark, d), arguments(spark, d), entities(spark, d))


def gold_mentions(spark: SparkSession, d: str) -> DataFrame:
    return op.gold_mentions(triples(spark, d), events(spark, d), arguments(spark, d), entities(spark, d))


def typed_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions matched by trigger alone: the ground of the queries on senses and tuples."""
    rows = triples(spark, d).join(trigger_types(spark, d), ["sent_id", "svo_no"])
    return rows.select(F.concat_ws("_", "sent_id", "svo_no").alias("mention"), "sent_id", F.col("lemma").alias("verb"), head_of(F.col("obj")).alias("obj_head"), "event_type")


def expansions(spark: SparkSession, d: str) -> DataFrame:
    tokens = deliver_once(table(spark, d, "corpus_parsed_svo"), "sent_id", ["sent_id", "token_list"]).select(F.col("sent_id").cast("bigint").alias("sent_id"), "token_list")
    rows = typed_mentions(spark, d).join(tokens, "sent_id").select("mention", "verb", F.posexplode("token_list").alias("place", "word")).where("word is not null and lower(word) <> verb")
    return rows.select("mention", "place", F.lower("word").alias("word"), F.round(1 / (F.col("place") + 1.0), 6).alias("prob"))


def with_sense_number(spark: SparkSession, d: str) -> DataFrame:
    kinds = typed_mentions(spark, d).select("verb", "event_type").distinct()
    w = Window.partitionBy("verb").orderBy("event_type")
    return typed_mentions(spark, d).join(kinds.withColumn("sense", F.row_number().over(w) - 1), ["verb", "event_type"])  # a verb has few types


def sense_words(spark: SparkSession, d: str) -> DataFrame:
    lists = expansions(spark, d).groupBy("mention").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("terms"))
    return op.sense_features(with_sense_number(spark, d).join(lists, "mention"))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """``verb, sense, words, vector``."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("sent_id"), "embedding")
    rows = with_sense_number(spark, d).join(vectors, "sent_id").select(F.struct("verb", "sense").alias("_key"), "embedding")
    means = packed(mean_vectors(rows, "_key", "embedding"), "_key").select("_key.*", "vector")
    return sense_words(spark, d).join(means, ["verb", "sense"], "left")


def senses(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("sent_id"), F.col("embedding").alias("vector"))
    rows = typed_mentions(spark, d).join(vectors, "sent_id", "left")
    return op.disambiguated(rows, expansions(spark, d), inventory(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with the label of their gold sense."""
    return with_sense_number(spark, d).withColumn("verb_sense", op.sense_label(F.col("verb"), F.col("sense")))


def type_frequency(spark: SparkSession, d: str) -> DataFrame:
    return op.type_ranks(typed_mentions(spark, d))


def object_tuples(spark: SparkSession, d: str) -> DataFrame:
    return op.tuples(labelled(spark, d), type_frequency(spark, d))


def head_expansions(spark: SparkSession, d: str) -> DataFrame:
    return op.expansion_sums(expansions(spark, d), typed_mentions(spark, d), "obj_head")


def head_vectors(spark: SparkSession, d: str) -> DataFrame:
    frequency = typed_mentions(spark, d).groupBy("obj_head").agg(F.count(F.lit(1)).alias("freq"))
    return op.tfidf_vectors(head_expansions(spark, d), frequency, "obj_head")


QUERIES = {
    "mentions_triggers": trigger_types,
    "mentions_objects": object_matches,
    "mentions_gold": gold_mentions,
    "mentions_type_frequency": type_frequency,
    "mentions_tuples": object_tuples,
    "mentions_sense_words": lambda spark, d: sense_words(spark, d).withColumn("words", F.array_join("words", " ")),
    "mentions_senses": senses,
    "mentions_head_expansions": head_expansions,
    "mentions_head_vectors": head_vectors,
}

B = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_M = rf"""
WITH once AS (SELECT DISTINCT sent_id, svos FROM corpus_parsed_svo WHERE sent_id IS NOT NULL),
tr AS (SELECT sent_id::BIGINT AS sent_id, i - 1 AS svo_no, svos[i] AS s FROM (SELECT *, unnest(range(1, len(svos) + 1)) AS i FROM once) WHERE svos[i] IS NOT NULL),
t AS (SELECT sent_id, svo_no::INT AS svo_no, nullif(lower(regexp_replace(regexp_replace(s.verb.lemma, '^{B}+|{B}+$', '', 'g'), '^!{B}*', '')), '') AS lemma, s.verb.idx AS verb_index,
  nullif(lower(trim(regexp_replace(s.obj.text, '{B}+', ' ', 'g'))), '') AS obj, s.obj.idx AS idx FROM tr),
trip AS (SELECT * FROM t WHERE lemma IS NOT NULL AND obj IS NOT NULL),
gold AS (SELECT DISTINCT inst_id AS sent_id, event_mentions, entity_mentions FROM train_oneie WHERE inst_id IS NOT NULL),
ev AS (SELECT sent_id, i - 1 AS event_no, event_mentions[i] AS e FROM (SELECT *, unnest(range(1, len(event_mentions) + 1)) AS i FROM gold) WHERE event_mentions[i].event_type IS NOT NULL AND event_mentions[i].trigger IS NOT NULL),
arg AS (SELECT DISTINCT sent_id, a.entity_id AS entity_id FROM (SELECT sent_id, unnest(e.arguments) AS a FROM ev) WHERE a.entity_id IS NOT NULL),
ent AS (SELECT sent_id, m.id AS entity_id, m.mention_type AS kind, m."start" AS s, m."end" AS f FROM (SELECT sent_id, unnest(entity_mentions) AS m FROM gold) WHERE m.id IS NOT NULL),
trig AS (SELECT sent_id, svo_no, arg_max(e.event_type, event_no) AS event_type FROM trip JOIN ev USING (sent_id) WHERE e.trigger."end" - e.trigger."start" = 1 AND e.trigger."start" = verb_index GROUP BY ALL),
obj AS (SELECT DISTINCT trip.sent_id, svo_no FROM trip JOIN ent ON ent.sent_id = trip.sent_id JOIN arg ON arg.sent_id = ent.sent_id AND arg.entity_id = ent.entity_id
  WHERE (kind IS NULL OR kind <> 'PRO') AND ((idx[1] >= s AND idx[1] < f) OR (idx[-1] >= s AND idx[-1] < f))),
men AS (SELECT sent_id || '_' || svo_no AS mention, sent_id, lemma AS verb, string_split(obj, ' ')[-1] AS obj_head, event_type FROM trip JOIN trig USING (sent_id, svo_no)),
tok AS (SELECT DISTINCT sent_id::BIGINT AS sent_id, token_list FROM corpus_parsed_svo),
ex AS (SELECT mention, i - 1 AS place, lower(token_list[i]) AS word, round(1 / (i - 1 + 1.0::DOUBLE), 6) AS prob FROM (SELECT *, unnest(range(1, len(token_list) + 1)) AS i FROM men JOIN tok USING (sent_id)) WHERE token_list[i] IS NOT NULL AND lower(token_list[i]) <> verb),
kind AS (SELECT verb, event_type, row_number() OVER (PARTITION BY verb ORDER BY event_type) - 1 AS sense FROM (SELECT DISTINCT verb, event_type FROM men)),
num AS (SELECT men.*, sense FROM men JOIN kind USING (verb, event_type)),
tf AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type)::INT AS rank FROM men GROUP BY event_type ORDER BY n DESC, event_type LIMIT 15),
pl AS (SELECT mention, word, row_number() OVER (PARTITION BY mention ORDER BY place) AS p FROM ex), fr AS (SELECT mention, word, min(p) AS r FROM pl GROUP BY ALL),
sw AS (SELECT verb, sense, word AS term, round(sum(1 / ln(1 + r)), 9) AS w FROM fr JOIN num USING (mention) GROUP BY ALL),
sk AS (SELECT *, row_number() OVER (PARTITION BY verb, sense ORDER BY w DESC, term) AS k FROM sw),
sf AS (SELECT verb, sense, list(term ORDER BY k) AS words FROM sk WHERE k <= 10 GROUP BY verb, sense),
hx AS (SELECT obj_head, word, round(sum(prob), 6) AS weight FROM ex JOIN men USING (mention) GROUP BY ALL),
hf AS (SELECT obj_head, count(*) AS freq FROM men GROUP BY obj_head)
"""
SQL = {
    "mentions_triggers": _M + "SELECT * FROM trig",
    "mentions_objects": _M + "SELECT * FROM obj",
    "mentions_gold": _M + "SELECT sent_id || '_' || svo_no AS mention, sent_id, lemma AS verb, verb_index, obj, event_type FROM trip JOIN trig USING (sent_id, svo_no) JOIN (SELECT sent_id, svo_no FROM obj) USING (sent_id, svo_no)",
    "mentions_type_frequency": _M + "SELECT * FROM tf",
    "mentions_tuples": _M + "SELECT verb || '_' || sense AS verb_sense, obj_head, count(*) AS freq, arg_min(num.event_type, rank) AS event_type FROM num JOIN tf ON tf.event_type = num.event_type GROUP BY 1, 2",
    "mentions_sense_words": _M + "SELECT verb, sense::INT AS sense, array_to_string(words, ' ') AS words FROM sf",
    "mentions_senses": _M + """, rk AS (SELECT mention, list(word ORDER BY w DESC, word) AS ranked FROM (SELECT mention, word, round(sum(1 / ln(2 + place)), 9) AS w FROM ex GROUP BY ALL) GROUP BY mention),
vec AS (SELECT vec_id AS sent_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
ax AS (SELECT verb, sense, i, avg(v[i]) AS m FROM (SELECT verb, sense, v, unnest(range(1, len(v) + 1)) AS i FROM num JOIN vec USING (sent_id)) GROUP BY ALL), sv AS (SELECT verb, sense, list(m ORDER BY i) AS sv FROM ax GROUP BY ALL),
inv AS (SELECT sf.*, sv, count(*) OVER (PARTITION BY verb) AS n FROM sf LEFT JOIN sv USING (verb, sense)), nn AS (SELECT verb, any_value(n) AS n FROM inv GROUP BY verb),
sc AS (SELECT mention, sense, round(coalesce(list_cosine_similarity(v, sv), 0) * (SELECT sum(len(list_intersect(list_slice(ranked, 1, d), list_slice(words, 1, d)))::DOUBLE / d) FROM range(1, 11) r(d)) / 10, 9) AS s
  FROM men JOIN vec USING (sent_id) JOIN inv USING (verb) JOIN rk USING (mention) WHERE n > 1),
bs AS (SELECT mention, sense FROM sc QUALIFY row_number() OVER (PARTITION BY mention ORDER BY s DESC, sense) = 1)
SELECT mention, verb, (CASE WHEN v IS NULL THEN -2 WHEN n IS NULL THEN -1 WHEN n = 1 THEN 0 ELSE sense END)::INT AS sense FROM men LEFT JOIN vec USING (sent_id) LEFT JOIN nn USING (verb) LEFT JOIN bs USING (mention)""",
    "mentions_head_expansions": _M + "SELECT * FROM hx",
    "mentions_head_vectors": _M + """, c AS (SELECT obj_head, word, ceil(weight * freq) AS n FROM hx JOIN hf USING (obj_head) WHERE ceil(weight * freq) > 0), df AS (SELECT word, count(*) AS df FROM c GROUP BY word),
v AS (SELECT obj_head, word, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM hf)) / (1 + df)::DOUBLE) + 1) AS v FROM c JOIN df USING (word)),
nm AS (SELECT obj_head, sqrt(sum(v * v)) AS norm FROM v GROUP BY obj_head) SELECT obj_head, word, round(v / norm, 6) AS value FROM v JOIN nm USING (obj_head)""",
}
