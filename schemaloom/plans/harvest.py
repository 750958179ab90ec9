"""Queries of the whole way from completions to schemas.

No generator runs here: the completion of a verb-object pair in a sentence stands in for a model's. Its event is the
sentence's verbs, its slots are the last words of the sentence's subjects and objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.svo import triples_once
from schemaloom.operators import graph, harvest, models
from schemaloom.operators.salience import head_of
from schemaloom.plans import salience
from schemaloom.session import table, with_checkpoints

TOP = 500


def completions(spark: SparkSession, d: str) -> DataFrame:
    """``ordinal, raw``: one completion a triple with verb and object."""
    rows = triples_once(table(spark, d, "corpus_parsed_svo")).where("lemma is not null and sent_id is not null")
    words = F.array_distinct(F.flatten(F.collect_list(F.array(head_of(F.col("subj")), head_of(F.col("obj"))))))
    # A sentence has few triples, so its words fit a row.
    sentence = rows.groupBy("sent_id").agg(F.array_join(F.array_sort(F.collect_set("lemma")), "/").alias("event"), F.array_sort(F.filter(words, lambda w: w.isNotNull())).alias("slots"))
    own = rows.where("obj is not null").select("sent_id", "lemma", head_of(F.col("obj")).alias("head")).distinct()
    raw = F.concat_ws(" ", "lemma", "head", F.lit("&"), F.translate("event", " ", "_"), F.array_join("slots", " "))
    return own.join(sentence, "sent_id").select("sent_id", raw.alias("raw"))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return harvest.parsed_completions(completions(spark, d)).select("sent_id", "vo", "verb", "head", "event", "slots")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """The samples of the most salient instances, written once: every later step reads them."""
    with_checkpoints(spark)
    kept = harvest.salient_completions(parsed(spark, d), salience.salient_verbs(spark, d), salience.salient_heads(spark, d))
    return harvest.top_instances(harvest.instances(kept, "sent_id"), TOP).checkpoint()


def instance_rows(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("instance", "verb", "head", "salience", "sample", "event", F.array_join("slots", " ").alias("slots"))


def refined(spark: SparkSession, d: str) -> DataFrame:
    rows = harvest.with_refined_events(samples(spark, d))
    return rows.select("instance", "sample", "event", F.round("similarity", 6).alias("similarity"))


def sense_slot_scores(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF weighed by word sense."""
    rows = harvest.with_refined_events(samples(spark, d))
    return harvest.slot_scores(rows, ("tfidf", "sense")).drop("rank")


def sense_events(spark: SparkSession, d: str) -> DataFrame:
    rows = harvest.with_refined_events(samples(spark, d))
    return harvest.chosen_events(rows, harvest.slot_scores(rows, ("tfidf", "sense")))


def sense_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = harvest.with_refined_events(samples(spark, d)).checkpoint()
    events = harvest.chosen_events(rows, harvest.slot_scores(rows, ("tfidf", "sense")))
    return harvest.instance_edges(events.join(rows.select("instance", "verb").distinct(), "instance"))


def verb_edges(spark: SparkSession, d: str) -> DataFrame:
    return harvest.instance_edges(samples(spark, d).select("instance", "verb", F.lit("none").alias("event")).distinct(), "VerbMatch")


def rank_slot_scores(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF and PageRank summed, the default of the harvest."""
    return harvest.slot_scores(samples(spark, d)).drop("sense")


def clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of clusters, events and scores of the instances."""
    rows = samples(spark, d)
    scores = harvest.slot_scores(rows).checkpoint()
    events = harvest.chosen_events(rows, scores)
    own = rows.select("instance", "verb", "salience").distinct()
    nodes = own.select(F.col("instance").alias("node"), (-F.col("salience")).alias("position"))
    found = graph.communities(nodes, harvest.instance_edges(events.join(own, "instance"))).checkpoint()
    members = found.select(F.col("node").alias("instance"), F.col("community").alias("cluster")).join(own, "instance")
    return members, events, scores


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Members of each cluster, the most salient first."""
    return clustered(spark, d)[0].select("cluster", "instance", "salience").orderBy("cluster", F.desc("salience"), "instance")


def schemas(spark: SparkSession, d: str) -> DataFrame:
    return harvest.schema_table(*clustered(spark, d), models.hashed_encoder())


QUERIES = {
    "schema_completions": lambda spark, d: parsed(spark, d).withColumn("slots", F.array_join("slots", " ")),
    "schema_instances": instance_rows,
    "schema_refined_events": refined,
    "schema_sense_slots": sense_slot_scores,
    "schema_sense_events": sense_events,
    "schema_edges": sense_edges,
    "schema_verb_edges": verb_edges,
    "schema_slots": rank_slot_scores,
    "schema_clusters": clusters,
    "schema_table": schemas,
}

_C = salience._SAL + """, full_t AS (SELECT * FROM t WHERE lemma IS NOT NULL AND sent_id IS NOT NULL),
ev AS (SELECT sent_id, string_agg(lemma, '/' ORDER BY lemma) AS event FROM (SELECT DISTINCT sent_id, lemma FROM full_t) GROUP BY sent_id),
word AS (SELECT DISTINCT sent_id, word FROM (SELECT sent_id, string_split(subj, ' ')[-1] AS word FROM full_t UNION ALL SELECT sent_id, string_split(obj, ' ')[-1] FROM full_t) WHERE word IS NOT NULL),
own AS (SELECT DISTINCT sent_id, lemma, string_split(obj, ' ')[-1] AS head FROM full_t WHERE obj IS NOT NULL),
rhs AS (SELECT sent_id, lemma, head, string_split(lemma || ' ' || head, ' ') AS lw, replace(event, ' ', '_') AS event, (SELECT list(word ORDER BY word) FROM word w WHERE w.sent_id = own.sent_id) AS slots FROM own JOIN ev USING (sent_id)),
parsed AS (SELECT sent_id, lw[1] || ' ' || lw[2] AS vo, lw[1] AS verb, lw[2] AS head, CASE WHEN len(slots) > 0 THEN event ELSE 'none' END AS event, coalesce(slots, []::VARCHAR[]) AS slots FROM rhs)
"""
_I = _C + """, sal AS (SELECT p.*, round(vt.salience * ht.salience, 4) AS salience FROM parsed p JOIN vt ON p.verb = vt.term JOIN ht ON p.head = ht.term),
num AS (SELECT *, row_number() OVER (PARTITION BY vo ORDER BY sent_id) - 1 AS k, count(*) OVER (PARTITION BY vo) AS al FROM sal),
batch AS (SELECT vo || '#' || (k // 3) AS instance, verb, head, salience, (k % 3)::INT AS sample, event, slots FROM num WHERE (k // 3 + 1) * 3 <= al),
top AS (SELECT DISTINCT instance, salience FROM batch ORDER BY salience DESC, instance LIMIT 500),
smp AS (SELECT * FROM batch WHERE instance IN (SELECT instance FROM top))
"""
_J = "(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))))"
_BG = "CASE WHEN length({x}) > 1 THEN list_distinct(list_transform(range(1, length({x})), lambda z: substr({x}, z, 2))) ELSE [{x}] END"
_R = _I + f""", ps AS (SELECT instance, sample, verb, head, event AS whole, CASE WHEN contains(event, '/') THEN string_split(event, '/') WHEN contains(event, '-') THEN string_split(event, '-') ELSE [event] END AS parts FROM smp),
pt AS (SELECT *, i, parts[i] AS part, {_BG.format(x='parts[i]')} AS bp, {_BG.format(x='verb')} AS bv, {_BG.format(x='head')} AS bo FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM ps)),
sm AS (SELECT *, {_J.format(a='bp', b='bv')} AS sv, {_J.format(a='bp', b='bo')} AS so FROM pt),
pick AS (SELECT instance, sample, any_value(verb) AS verb, any_value(head) AS head, any_value(whole) AS whole, any_value(len(parts)) AS n, bool_or(so > sv) AS to_head, max(greatest(sv, so)) AS sim,
  arg_max(part, struct_pack(s := greatest(sv, so), i := -i)) FILTER (greatest(sv, so) > 0) AS part FROM sm GROUP BY instance, sample),
chosen AS (SELECT *, CASE WHEN n = 1 THEN whole ELSE part END AS c FROM pick),
ref AS (SELECT instance, sample, verb, head, CASE WHEN to_head AND c IS NOT NULL AND c <> head THEN c || '-' || head WHEN c IS NULL AND to_head AND whole <> head THEN whole || '-' || head ELSE coalesce(c, whole) END AS event, sim FROM chosen),
sl AS (SELECT instance, sample, unnest(slots) AS slot FROM smp),
loc AS (SELECT instance, slot, count(*) AS local FROM sl GROUP BY ALL), ov AS (SELECT slot, sum(local)::BIGINT AS overall FROM loc GROUP BY slot),
tf AS (SELECT instance, slot, round((1 + pow(log10(local), 2)) * log10((SELECT count(DISTINCT instance) FROM smp)::DOUBLE / overall), 4) AS tfidf FROM loc JOIN ov USING (slot)),
sn0 AS (SELECT instance, slot, round(max(sim), 4) AS sense FROM sl JOIN ref USING (instance, sample) GROUP BY ALL),
sn AS (SELECT instance, slot, CASE WHEN max(sense) OVER (PARTITION BY instance) > 0 THEN sense END AS sense FROM sn0),
tt AS (SELECT *, round(tfidf * coalesce(sense, 1.0), 4) AS total FROM tf JOIN sn USING (instance, slot)),
sc AS (SELECT *, round((total - min(total) OVER w) / nullif(max(total) OVER w - min(total) OVER w, 0), 4) AS score FROM tt WINDOW w AS (PARTITION BY instance)),
kp AS (SELECT *, coalesce(score >= 1.0 / 3, false) AS kept FROM sc),
es AS (SELECT r.instance, r.sample, r.event, r.verb, coalesce((SELECT sum(score::DECIMAL(18,4)) FROM sl JOIN kp USING (instance, slot) WHERE kept AND sl.instance = r.instance AND sl.sample = r.sample), 0)::DOUBLE AS total FROM ref r),
evt AS (SELECT instance, event, verb, total FROM es QUALIFY row_number() OVER (PARTITION BY instance ORDER BY total DESC, sample) = 1),
ep AS (SELECT instance, string_split(lower(trim(event)), '/') AS p FROM evt), ec AS (SELECT instance, len(p) AS n, unnest(p) AS part FROM ep WHERE p[1] <> 'none'),
edge AS (SELECT a, b, round(sum(w), 6) AS w FROM (SELECT x.instance AS a, y.instance AS b, 3.0::DOUBLE AS w FROM evt x JOIN evt y ON x.verb = y.verb AND x.instance < y.instance
  UNION ALL SELECT x.instance, y.instance, count(*)::DOUBLE / (x.n * y.n) FROM ec x JOIN ec y ON x.part = y.part AND x.instance < y.instance GROUP BY x.instance, y.instance, x.n, y.n) GROUP BY a, b)
"""
SQL = {
    "schema_completions": _C + "SELECT sent_id, vo, verb, head, event, array_to_string(slots, ' ') AS slots FROM parsed",
    "schema_instances": _I + "SELECT instance, verb, head, salience, sample, event, array_to_string(slots, ' ') AS slots FROM smp",
    "schema_refined_events": _R + "SELECT instance, sample, event, round(sim, 6) AS similarity FROM ref",
    "schema_sense_slots": _R + "SELECT instance, slot, tfidf, sense, total, score, kept FROM kp",
    "schema_sense_events": _R + "SELECT instance, event, total FROM evt",
    "schema_edges": _R + "SELECT a, b, w FROM edge",
    "schema_verb_edges": _I + "SELECT x.instance AS a, y.instance AS b, 3.0::DOUBLE AS w FROM (SELECT DISTINCT instance, verb FROM smp) x JOIN (SELECT DISTINCT instance, verb FROM smp) y ON x.verb = y.verb AND x.instance < y.instance",
}
