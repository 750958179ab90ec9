"""Readers of the text, JSON, XML and block formats. Compressed files are read by their extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators.ranking import ranked
from schemaloom.operators.triples import at_least, without_pos
from schemaloom.sources import schemas

RECORD_SEPARATOR = "\n\n###\n\n"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line. Lines that don't parse keep their text in ``_corrupt_record``, so they can be counted."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one array of ``[id, {"sentences": [...]}]``: ``id, sentences``."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("items"))
    items = whole.select(F.explode("items").alias("i"))
    return items.select(F.col("i")[0].alias("id"), F.from_json(F.col("i")[1], "sentences array<string>")["sentences"].alias("sentences"))


def keyed_object(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A file that is one object: ``key, value``. Convert such files to tables once; each is read by one task."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value_schema}>").alias("m"))
    return whole.select(F.explode("m").alias("key", "value"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def text_blocks(spark: SparkSession, path: str, separator: str = "\n\n") -> DataFrame:
    """Blocks between separators, without empty ones."""
    return spark.read.option("lineSep", separator).text(path).where(F.trim("value") != "").withColumnRenamed("value", "block")


def news_xml(spark: SparkSession, folder: str, row_tag: str = "nitf") -> DataFrame:
    """News articles of a tree of folders, archives left out: ``file, title, paragraphs``."""
    rows = spark.read.format("xml").schema(schemas.NEWS_XML).option("rowTag", row_tag).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(folder)
    headings = F.concat(F.coalesce("hl1", F.array().cast("array<string>")), F.coalesce("p", F.array().cast("array<string>")))
    return rows.select(F.input_file_name().alias("file"), "title", F.transform(headings, lambda x: F.trim(x)).alias("paragraphs"))


def wiki_dump(spark: SparkSession, path: str, namespaces: tuple[str, ...] = (), url_base: str = "") -> DataFrame:
    """Pages of an export: ``id, revid, url, title, text``.

    A page whose title has no colon is always kept; another only in one of ``namespaces``, if it is no redirect.
    """
    rows = spark.read.format("xml").schema(schemas.WIKI_XML).option("rowTag", "page").load(path)
    space = F.split_part("title", F.lit(":"), F.lit(1))
    keep = ~F.col("title").contains(":") | (space.isin(*namespaces) & F.col("redirect").isNull())
    return rows.where(keep).select(
        F.col("id").cast("string").alias("id"), F.col("revision.id").cast("string").alias("revid"),
        F.format_string(f"{url_base}?curid=%s", F.col("id").cast("string")).alias("url"), "title", F.col("revision.text").alias("text"))


def wiki_pages(spark: SparkSession, path: str, namespaces: tuple[str, ...] = (), url_base: str = "") -> DataFrame:
    """As ``wiki_dump``, without pages of a namespace that repeat the id of the page kept before them."""
    rows = wiki_dump(spark, path, namespaces, url_base).withColumn("_row", F.monotonically_increasing_id())
    numbered = ranked(rows, [], [F.col("_row")], "_n")
    before = numbered.select((F.col("_n") + 1).alias("_n"), F.col("id").alias("_last"))
    kept = numbered.join(before, "_n", "left").where(~F.col("title").contains(":") | ~F.col("id").eqNullSafe(F.col("_last")))
    return kept.select("id", "revid", "url", "title", "text")


def wiki_templates(spark: SparkSession, path: str, prefix: str = "Template:") -> DataFrame:
    """Definitions of templates: ``name, body, target`` (``target`` for a redirect)."""
    rows = spark.read.format("xml").schema(schemas.WIKI_XML).option("rowTag", "page").load(path).where(F.col("title").startswith(prefix))
    target = F.nullif(F.regexp_extract("revision.text", r"(?i)^#redirect\s*\[\[([^\]|]+)", 1), F.lit(""))
    return rows.select(F.substr("title", F.lit(len(prefix) + 1)).alias("name"), F.col("revision.text").alias("body"), target.alias("target"))


def site_info(spark: SparkSession, path: str) -> DataFrame:
    """``sitename, base, namespaces`` of an export's head."""
    schema = "sitename string, base string, namespaces struct<namespace:array<string>>"
    return spark.read.format("xml").schema(schema).option("rowTag", "siteinfo").load(path).select("sitename", "base", F.col("namespaces.namespace").alias("namespaces"))


def completions(spark: SparkSession, path: str, line: int = 0) -> DataFrame:
    """Records of generated text: ``record_no, raw``, the ``line``-th line of each.

    A record counts only if its separator follows. Files have no order of rows, so the number is that of the
    record in its file, found from whole files.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", RECORD_SEPARATOR).alias("r"))
    rows = whole.select("file", F.posexplode(F.slice("r", 1, F.size("r") - 1)).alias("record_no", "record"))
    return rows.select("file", "record_no", F.try_element_at(F.split("record", "\n"), F.lit(line + 1)).alias("raw"))


def triple_table(spark: SparkSession, path: str, least: float | None = None) -> DataFrame:
    """Tab-separated triples with weights, marks of parts of speech removed."""
    rows = spark.read.csv(path, sep="\t", schema=schemas.TRIPLES)
    return at_least(rows.select(*(without_pos(F.col(c)).alias(c) for c in ("predicate", "subject", "object")), "weight"), "weight", least)


def count_table(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``count word context relation``; lines with another number of fields are marked, not dropped."""
    rows = spark.read.text(path).withColumn("f", F.split(F.trim("value"), r"\s+"))
    ok = F.size("f") == 4
    return rows.select(F.when(ok, F.try_element_at("f", F.lit(1)).try_cast("bigint")).alias("n"), *(F.when(ok, F.try_element_at("f", F.lit(i))).alias(c) for i, c in ((2, "word"), (3, "context"), (4, "relation"))), ok.alias("valid"))


def frame_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``# Cluster n`` blocks: ``cid, predicates, subjects, objects``."""
    rows = spark.read.option("lineSep", "# Cluster ").text(path).where(F.trim("value") != "")
    members = lambda role: F.filter(F.split(F.regexp_extract("value", rf"(?m)^{role}: (.*)$", 1), ", "), lambda x: x != "")
    return rows.select(F.regexp_extract("value", r"^(\d+)", 1).alias("cid"), *(members(r).alias(r.lower()) for r in ("Predicates", "Subjects", "Objects")))


def gold_frames(spark: SparkSession, path: str) -> DataFrame:
    """Blocks ``# frame: ...`` of tab-separated triples: ``frame, subject, verb, object``."""
    rows = spark.read.option("lineSep", "\n# ").text(path).withColumn("value", F.regexp_replace("value", "^# ", ""))
    lines = rows.select(F.regexp_extract("value", r"^([^:\n]+)", 1).alias("frame"), F.explode(F.slice(F.split("value", "\n"), 2, 1 << 30)).alias("line")).where("line <> ''")
    part = F.split("line", "\t")
    return lines.where(F.size(part) >= 3).select("frame", part[0].alias("subject"), part[1].alias("verb"), part[2].alias("object"))


def verb_classes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lines whose third field lists verbs: ``class, verb``."""
    part = F.split("value", r"\t+")
    return spark.read.text(path).where(F.size(part) >= 3).select(part[0].alias("class"), F.explode(F.split(part[2], " +")).alias("verb")).where("verb <> ''")


def set_triples(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Lines of three ``<a, b>`` sets, the head line dropped: ``predicates, subjects, objects``."""
    rows = spark.read.option("encoding", encoding).csv(path, sep="\t", header=True, schema="a string, b string, c string")
    bag = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(c, r"[<>{}]", ""), r",\s*"), lambda x: x != ""))
    return rows.select(bag("a").alias("predicates"), bag("b").alias("subjects"), bag("c").alias("objects"))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """Votes of a rater, lines with an empty field left out."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=schemas.RATINGS)
    return rows.dropna().withColumn("rater", F.element_at(F.split(F.input_file_name(), "/"), -1))


def conll(spark: SparkSession, path: str) -> DataFrame:
    """Dependency sentences: ``sentence, src, token, lemma, pos, dep, dst`` a row an edge, for files with relations before heads.

    A token of several heads (joined by ``|``) gives a row for each; equal sentences share an id. ``lexical.sentences``
    with ``dependencies`` and ``frame_roles`` read files with heads first, keep equal sentences apart and the frames.
    """
    blocks = text_blocks(spark, path).withColumn("sentence", F.xxhash64("block"))
    lines = blocks.select("sentence", F.explode(F.split("block", "\n")).alias("line"))
    f = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("#") & (F.size(f) >= 10))
    heads = rows.select("sentence", f[0].cast("int").alias("src"), f[1].alias("token"), f[2].alias("lemma"), f[4].alias("pos"), F.explode(F.arrays_zip(F.split(f[9], r"\|").alias("dst"), F.split(f[8], r"\|").alias("dep"))).alias("h"))
    return heads.select("sentence", "src", "token", "lemma", "pos", F.col("h.dep").alias("dep"), F.col("h.dst").alias("dst"))


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; where there is none, what ``build`` gives is written there first."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
