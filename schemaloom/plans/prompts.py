"""Queries that turn gold records into exemplars and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import prompts as op
from schemaloom.plans import salience
from schemaloom.plans.salience import top_pairs
from schemaloom.session import deliver_once, table


def english_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Arguments joined to the first entity mention of the record with their id, pronouns left out."""
    gold = deliver_once(table(spark, d, "train_oneie"), "inst_id", ["inst_id", "event_mentions", "entity_mentions"])
    events = gold.select("inst_id", F.posexplode("event_mentions").alias("event_no", "e")).where("e is not null and e.event_type is not null and e.trigger.text is not null")
    arguments = events.select("inst_id", "event_no", "e.event_type", F.col("e.trigger.text").alias("trigger"), F.posexplode("e.arguments").alias("arg_no", "a")).where("a is not null")
    arguments = arguments.select("inst_id", "event_no", "event_type", "trigger", "arg_no", F.col("a.entity_id").alias("entity_id"), F.col("a.role").alias("role"), F.col("a.text").alias("text"))
    entities = gold.select("inst_id", F.posexplode("entity_mentions").alias("pos", "m")).where("m.id is not null")
    first = entities.groupBy("inst_id", F.col("m.id").alias("entity_id")).agg(F.min(F.struct("pos", F.col("m.mention_type").alias("kind"))).alias("x"))
    return arguments.join(first, ["inst_id", "entity_id"]).where("x.kind is null or x.kind <> 'PRO'").select(
        "inst_id", "event_no", "event_type", "trigger", "arg_no", "role", "text", F.col("x.kind").alias("mention_type"))


def role_sets(spark: SparkSession, d: str) -> DataFrame:
    """Roles of each event type; a type has few, and they are counted per role before they are gathered."""
    gold = deliver_once(table(spark, d, "train_oneie"), "inst_id", ["inst_id", "event_mentions"])
    events = gold.select(F.explode("event_mentions").alias("e")).select("e.event_type", F.explode("e.arguments").alias("a"))
    roles = events.select("event_type", F.col("a.role").alias("role")).where("event_type is not null and role is not null")
    counted = roles.groupBy("event_type", "role").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("role")), " ").alias("roles"), F.sum("n").alias("n"))


def exemplars(spark: SparkSession, d: str) -> DataFrame:
    """One prompt line an event with an argument: the trigger, its first argument, the type and the roles."""
    rows = english_arguments(spark, d).where("role is not null and text is not null")
    event = rows.groupBy("inst_id", "event_no", "event_type", "trigger").agg(F.array_sort(F.collect_list(F.struct("arg_no", "role", "text"))).alias("args"))
    line = op.prompt_line(F.col("event_type"), F.col("trigger"), F.col("args")[0]["text"], F.transform("args", lambda a: a["role"]))
    return event.select("inst_id", "event_no", op.type_group(F.col("event_type")).alias("event_group"), line.alias("line"))


def zh_exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Chinese lines; arguments of more than 32 characters are left out."""
    gold = deliver_once(table(spark, d, "train_event_list"), "inst_id", ["inst_id", "event_list"])
    events = gold.select("inst_id", F.posexplode("event_list").alias("event_no", "e")).where("e.event_type is not null and e.trigger is not null")
    kept = F.filter("e.arguments", lambda a: a["argument"].isNotNull() & a["role"].isNotNull() & (F.char_length(a["argument"]) <= op.MAX_ARGUMENT))
    events = events.withColumn("args", kept).where(F.size("args") > 0)
    line = op.prompt_line(F.col("e.event_type"), F.col("e.trigger"), F.col("args")[0]["argument"], F.transform("args", lambda a: a["role"]))
    return events.select("inst_id", "event_no", op.type_group(F.col("e.event_type")).alias("event_group"), line.alias("line"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    return top_pairs(spark, d).select(F.concat_ws(" ", "lemma", "head").alias("vo"))


def choice(spark: SparkSession, d: str) -> DataFrame:
    return op.exemplar_choice(exemplars(spark, d), targets(spark, d), "event_group", "line", "vo", 5)


def prompt_table(spark: SparkSession, d: str) -> DataFrame:
    return op.prompts(choice(spark, d))


def exemplar_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = english_arguments(spark, d).withColumn("ordinal", F.struct("inst_id", "event_no", "arg_no"))
    return op.batches(rows, "event_type", "ordinal").groupBy("event_type", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("inst_id").alias("first_inst"))


def sentence_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that show whole sentences: five drawn exemplar sentences and the sentence to be read, without blanks in Chinese."""
    gold = deliver_once(table(spark, d, "train_event_list"), "inst_id", ["inst_id", "text", "event_list"])
    typed = gold.where("text is not null").select("inst_id", "text", F.explode("event_list").alias("e")).where("e.event_type is not null")
    lines = op.sentence_line(F.col("text"), F.col("e.event_type"), F.transform(F.filter("e.arguments", lambda a: a["role"].isNotNull()), lambda a: a["role"]))
    rows = typed.select(op.type_group(F.col("e.event_type")).alias("event_group"), lines.alias("line"))
    wanted = deliver_once(table(spark, d, "corpus"), "sent_id", ["sent_id", "text", "dataset"]).where("text is not null and dataset like '%zh'")
    targets = op.seeded_sample(wanted, "sent_id", 100).select(op.without_blanks(F.col("text")).alias("sentence"))
    return op.prompts(op.exemplar_choice(rows, targets, "event_group", "line", "sentence", 5))


QUERIES = {
    "prompt_sentences": sentence_prompts,
    "prompt_arguments": english_arguments,
    "prompt_role_sets": role_sets,
    "prompt_exemplars": exemplars,
    "prompt_zh_exemplars": zh_exemplars,
    "prompt_choice": choice,
    "prompt_table": prompt_table,
    "prompt_batches": exemplar_batches,
}

_ARGS = """
WITH gold AS (SELECT DISTINCT inst_id, event_mentions, entity_mentions FROM train_oneie),
ev AS (SELECT inst_id, entity_mentions, i - 1 AS event_no, event_mentions[i] AS e FROM (SELECT *, unnest(range(1, len(event_mentions) + 1)) AS i FROM gold)),
arg AS (SELECT inst_id, event_no, e.event_type AS event_type, e.trigger.text AS trigger, j - 1 AS arg_no, e.arguments[j] AS a
  FROM (SELECT *, unnest(range(1, len(e.arguments) + 1)) AS j FROM ev WHERE e.event_type IS NOT NULL AND e.trigger.text IS NOT NULL) WHERE e.arguments[j] IS NOT NULL),
ent AS (SELECT inst_id, k AS pos, entity_mentions[k] AS m FROM (SELECT *, unnest(range(1, len(entity_mentions) + 1)) AS k FROM gold)),
first_ent AS (SELECT inst_id, m.id AS id, arg_min(struct_pack(k := m.mention_type), pos).k AS mention_type FROM ent WHERE m.id IS NOT NULL GROUP BY 1, 2),
joined AS (SELECT arg.inst_id, event_no::INT AS event_no, event_type, trigger, arg_no::INT AS arg_no, a.role AS role, a.text AS text, mention_type
  FROM arg JOIN first_ent f ON f.inst_id = arg.inst_id AND f.id = a.entity_id WHERE mention_type IS NULL OR mention_type <> 'PRO')
"""
_CHOICE = salience._SAL + ", " + _ARGS.strip()[5:] + """, ln AS (SELECT DISTINCT regexp_split_to_array(event_type, '[:-]')[1] AS g,
  lower(trigger || ' ' || arg_min(text, arg_no) || ' & ' || regexp_split_to_array(event_type, '[:-]')[-1] || ' ' || string_agg(role, ' ' ORDER BY arg_no)) AS line
  FROM joined WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY inst_id, event_no, event_type, trigger),
rk AS (SELECT g, line, row_number() OVER (PARTITION BY g ORDER BY md5(line), line) AS r FROM ln), sz AS (SELECT g, count(*) AS s FROM rk GROUP BY g),
tg AS (SELECT DISTINCT lemma || ' ' || head AS vo FROM best),
dr AS (SELECT vo, g, s, md5('1234-' || vo || '-' || g) AS h, row_number() OVER (PARTITION BY vo ORDER BY md5('1234-' || vo || '-' || g), g) AS n FROM tg CROSS JOIN sz QUALIFY n <= 5),
ch AS (SELECT vo AS target, n::INT AS n, dr.g AS event_group, line FROM dr JOIN rk ON rk.g = dr.g AND rk.r = ('0x' || substr(h, 1, 8))::BIGINT % s + 1)
"""
SQL = {
    "prompt_choice": _CHOICE + "SELECT * FROM ch",
    "prompt_table": _CHOICE + "SELECT target, string_agg(line, chr(10) ORDER BY n) || chr(10) || target || ' &' AS prompt FROM ch GROUP BY target",
    "prompt_arguments": _ARGS + "SELECT * FROM joined",
    "prompt_role_sets": """WITH gold AS (SELECT DISTINCT inst_id, event_mentions FROM train_oneie), e AS (SELECT unnest(event_mentions) AS e FROM gold),
r AS (SELECT event_type, a.role AS role FROM (SELECT e.event_type AS event_type, unnest(e.arguments) AS a FROM e)), c AS (SELECT event_type, role, count(*) AS n FROM r WHERE event_type IS NOT NULL AND role IS NOT NULL GROUP BY ALL)
SELECT event_type, string_agg(role, ' ' ORDER BY role) AS roles, sum(n)::BIGINT AS n FROM c GROUP BY event_type""",
    "prompt_exemplars": _ARGS + """SELECT inst_id, event_no, regexp_split_to_array(event_type, '[:-]')[1] AS event_group,
lower(trigger || ' ' || arg_min(text, arg_no) || ' & ' || regexp_split_to_array(event_type, '[:-]')[-1] || ' ' || string_agg(role, ' ' ORDER BY arg_no)) AS line
FROM joined WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY inst_id, event_no, event_type, trigger""",
    "prompt_zh_exemplars": """WITH gold AS (SELECT DISTINCT inst_id, event_list FROM train_event_list),
ev AS (SELECT inst_id, i - 1 AS event_no, event_list[i] AS e FROM (SELECT *, unnest(range(1, len(event_list) + 1)) AS i FROM gold)),
k AS (SELECT inst_id, event_no, e, list_filter(e.arguments, lambda a: a.argument IS NOT NULL AND a.role IS NOT NULL AND length(a.argument) <= 32) AS args FROM ev WHERE e.event_type IS NOT NULL AND e.trigger IS NOT NULL)
SELECT inst_id, event_no::INT AS event_no, regexp_split_to_array(e.event_type, '[:-]')[1] AS event_group,
lower(e.trigger || ' ' || args[1].argument || ' & ' || regexp_split_to_array(e.event_type, '[:-]')[-1] || ' ' || array_to_string(list_transform(args, lambda a: a.role), ' ')) AS line FROM k WHERE len(args) > 0""",
    "prompt_batches": _ARGS + """, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY inst_id, event_no, arg_no) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS al FROM joined)
SELECT event_type, (k // 3)::INT AS batch, count(*) AS n, min(inst_id) AS first_inst FROM n WHERE (k // 3 + 1) * 3 <= al GROUP BY 1, 2""",
}
