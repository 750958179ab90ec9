"""Readers of vectors, dependency sentences with frames, frame lexicons, matrices and streams of lines."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators.ranking import ranked
from schemaloom.sources.readers import RECORD_SEPARATOR, text_lines

FULL_TEXT_XML = (
    "text string, annotationSet array<struct<_frameName:string,_luName:string,_frameID:string,"
    "layer:array<struct<_name:string,label:array<struct<_name:string,_start:int,_end:int>>>>>>"
)
FRAME_XML = "_name string, lexUnit array<struct<_name:string>>"
RELATION_XML = "_name string, frameRelation array<struct<_superFrameName:string,_subFrameName:string>>"
# How frames and their roles stand in the comments of a dependency sentence.
FRAME_LINE, ROLE_LINE = r'^# Frame "([^"]*)"', r"^#     ([^:]+):\s*([\d, ]+)$"


def normalised(vector: Column) -> Column:
    """A vector of unit length; one of length 0 stays as it is."""
    length = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def text_vectors(spark: SparkSession, path: str, unit: bool = True) -> DataFrame:
    """``word, vector`` of lines ``word x y z ...``; a head line of two numbers is passed over."""
    part = F.split(F.trim("value"), " +")
    rows = spark.read.text(path).where((F.size(part) > 2) | ~F.col("value").rlike(r"^\d+ \d+\s*$"))
    vector = F.transform(F.slice(part, 2, F.size(part)), lambda x: x.cast("double"))
    return rows.where(F.size(part) > 1).select(part[0].alias("word"), (normalised(vector) if unit else vector).alias("vector"))


def binary_vectors(spark: SparkSession, path: str, unit: bool = True) -> DataFrame:
    """``word, vector`` of files in the binary layout: a line with count and size, then each word, a blank and its floats.

    Each file is read by one task, as its words can't be found from the middle.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for content in part["content"]:
                body = bytes(content)
                at = body.index(b"\n") + 1
                count, size = (int(x) for x in body[:at].split())
                rows = []
                for _ in range(count):
                    blank = body.index(b" ", at)
                    word, at = body[at:blank].decode("utf-8", "replace").lstrip("\n"), blank + 1 + 4 * size
                    rows.append((word, np.frombuffer(body, "<f4", size, blank + 1).astype(float).tolist()))
                yield pd.DataFrame(rows, columns=["word", "vector"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "word string, vector array<double>")
    return rows.select("word", normalised(F.col("vector")).alias("vector")) if unit else rows


def ordered_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``file, record_no, record`` of plain UTF-8 files of any size, parted at ``separator``; a last record without one after it goes.

    Files are split among tasks. Order is that of the blocks and of the rows in them; whether the last record is
    ended shows in the length of the file.
    """
    rows = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_bytes"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("record"))
    numbered = ranked(rows, ["file"], [F.col("_block"), F.col("_row")], "record_no").withColumn("record_no", F.col("record_no") - 1)
    sizes = numbered.groupBy("file").agg(F.sum(F.octet_length("record") + len(separator.encode())).alias("_seen"), F.max("_bytes").alias("_all"), F.max("record_no").alias("_last"))
    return numbered.join(sizes, "file").where((F.col("_seen") <= F.col("_all")) | (F.col("record_no") < F.col("_last"))).select("file", "record_no", "record")


def completion_records(spark: SparkSession, path: str, line: int = 0) -> DataFrame:
    """``file, record_no, raw``: as ``readers.completions``, for files too large for one row."""
    rows = ordered_records(spark, path, RECORD_SEPARATOR)
    return rows.select("file", "record_no", F.try_element_at(F.split("record", "\n"), F.lit(line + 1)).alias("raw"))


def last_completions(records: DataFrame) -> DataFrame:
    """``vo, raw`` of records (``file, record_no, raw``): of several completions of a pair the last."""
    rows = records.withColumn("vo", F.trim(F.split_part("raw", F.lit("&"), F.lit(1))))
    return rows.groupBy("vo").agg(F.max_by("raw", F.struct("file", "record_no")).alias("raw"))


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """``sentence, line``: the lines of each blank-line block. A block's id is its place in its file, so equal sentences stay apart."""
    rows = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    block = F.concat_ws("#", name, F.col("_metadata.file_block_start").cast("string"), F.monotonically_increasing_id().cast("string"))
    # The number is given before lines are made, so that a block's lines share it.
    return rows.withColumn("sentence", block).select("sentence", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def dependencies(lines: DataFrame) -> DataFrame:
    """``sentence, src, token, lemma, pos, dst, dep`` of ``sentences``: a row an edge, several for a token of several heads
    (parted by ``|``), one with null ``dst`` for a token without a head (``_``). Lines of fewer than ten fields go."""
    f = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("# ") & (F.size(f) >= 10))
    heads = F.explode(F.arrays_zip(F.split(f[8], r"\|").alias("dst"), F.split(f[9], r"\|").alias("dep")))
    each = rows.select("sentence", f[0].try_cast("int").alias("src"), f[1].alias("token"), f[2].alias("lemma"), f[3].alias("pos"), heads.alias("h"))
    bare = lambda c: F.nullif(F.col(f"h.{c}"), F.lit("_"))
    return each.select("sentence", "src", "token", "lemma", "pos", bare("dst").try_cast("int").alias("dst"), bare("dep").alias("dep"))


def frame_roles(lines: DataFrame) -> DataFrame:
    """``sentence, frame_no, frame, role, unit, tokens`` of the frame comments of ``sentences``: ``tokens`` are the numbers of a role's
    tokens, ``unit`` their lemmas in order. A role with a token that isn't in the sentence goes."""
    comment = lines.where(F.col("line").startswith("# ")).select("sentence", "line_no", "line")
    frames = comment.where(F.col("line").rlike(FRAME_LINE)).select("sentence", F.col("line_no").alias("frame_no"), F.regexp_extract("line", FRAME_LINE, 1).alias("frame"))
    roles = comment.where(F.col("line").rlike(ROLE_LINE)).select(
        "sentence", "line_no", F.trim(F.regexp_extract("line", ROLE_LINE, 1)).alias("role"), F.transform(F.split(F.regexp_extract("line", ROLE_LINE, 2), ","), lambda x: F.trim(x).try_cast("int")).alias("tokens"))
    own = roles.join(frames, "sentence").where("frame_no < line_no").groupBy("sentence", "line_no", "role", "tokens").agg(F.max(F.struct("frame_no", "frame")).alias("x"))
    each = own.select("sentence", "x.frame_no", "x.frame", "line_no", "role", "tokens", F.posexplode("tokens").alias("place", "src"))
    lemmas = dependencies(lines).select("sentence", "src", "lemma").distinct()
    met = each.join(lemmas, ["sentence", "src"]).groupBy("sentence", "frame_no", "frame", "line_no", "role", "tokens").agg(F.array_sort(F.collect_list(F.struct("place", "lemma"))).alias("l"))
    return met.where(F.size("l") == F.size("tokens")).select("sentence", "frame_no", "frame", "role", F.array_join(F.transform("l", lambda x: x["lemma"]), " ").alias("unit"), "tokens")


def full_text_frames(spark: SparkSession, path: str) -> DataFrame:
    """``frame, role, unit`` of annotated sentences in XML: the lexical unit as role FEE, and the words of each frame element."""
    rows = spark.read.format("xml").schema(FULL_TEXT_XML).option("rowTag", "sentence").load(path)
    sets = rows.select("text", F.explode("annotationSet").alias("a")).where("a._frameID is not null")
    triggers = sets.select(F.col("a._frameName").alias("frame"), F.lit("FEE").alias("role"), F.col("a._luName").alias("unit"))
    layers = sets.select("text", F.col("a._frameName").alias("frame"), F.explode("a.layer").alias("l")).where("l._name = 'FE'")
    labels = layers.select("text", "frame", F.explode("l.label").alias("x")).where("x._end is not null")
    words = F.substr("text", F.col("x._start") + 1, F.col("x._end") - F.col("x._start") + 1)
    return triggers.unionByName(labels.select("frame", F.col("x._name").alias("role"), words.alias("unit")))


def lexical_units(spark: SparkSession, path: str) -> DataFrame:
    """``frame, unit`` of frame files in XML."""
    rows = spark.read.format("xml").schema(FRAME_XML).option("rowTag", "frame").load(path)
    return rows.select(F.col("_name").alias("frame"), F.explode("lexUnit").alias("u")).select("frame", F.col("u._name").alias("unit"))


def frame_relations(spark: SparkSession, path: str, kind: str = "Inheritance") -> DataFrame:
    """``parent, child`` of the relations of one kind between frames."""
    rows = spark.read.format("xml").schema(RELATION_XML).option("rowTag", "frameRelationType").load(path).where(F.col("_name") == kind)
    return rows.select(F.explode("frameRelation").alias("r")).select(F.col("r._superFrameName").alias("parent"), F.col("r._subFrameName").alias("child"))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order; without one there is no first row."""
    return df.orderBy(*order).limit(n)


def json_tree(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines of all files two levels below ``folder``, with ``file`` as ``dir/name``."""
    rows = spark.read.schema(schema).json(f"{folder}/*/*")
    return rows.withColumn("file", F.array_join(F.slice(F.split(F.input_file_name(), "/"), -2, 2), "/"))


def piped_lines(spark: SparkSession, lines: Iterable[str] | None = None) -> DataFrame:
    """``text``: the lines of standard input (or of ``lines``). A pipe is read where the program runs, so it must fit there."""
    rows = [(x.rstrip("\n"),) for x in (sys.stdin if lines is None else lines)]
    return spark.createDataFrame(rows, "text string")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``term, n``: lines of a term alone, or of a term and a count."""
    part = F.split("text", r"\s+")
    return text_lines(spark, path).where("text <> ''").select(part[0].alias("term"), F.try_element_at(part, F.lit(2)).try_cast("bigint").alias("n"))


def coo_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``row, col, value`` of a matrix kept as a table of its cells."""
    return spark.read.schema("row bigint, col bigint, value double").parquet(path)


def compressed_rows(spark: SparkSession, path: str) -> DataFrame:
    """``row, col, value`` of ``.npz`` files of compressed sparse rows (arrays ``data, indices, indptr``); a file is read by one task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for part in batches:
            for content in part["content"]:
                z = np.load(io.BytesIO(bytes(content)))
                row = np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
                yield pd.DataFrame({"row": row.astype(np.int64), "col": z["indices"].astype(np.int64), "value": z["data"].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "row bigint, col bigint, value double")


def indexed_by_predicate(triples: DataFrame) -> DataFrame:
    """``predicate, rows``: the numbers of each predicate's triples (``row``) in order, a row a predicate and number."""
    return triples.select("predicate", "row").distinct().orderBy("predicate", "row")


def byte_size(text: str) -> int:
    """``n``, ``nK``, ``nM`` or ``nG`` in bytes; a size below 200 KiB that isn't 0 is refused."""
    scale = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30}
    size = int(text[:-1]) * scale[text[-1].upper()] if text[-1:].upper() in scale else int(text)
    if size < 0 or 0 < size < 200 << 10:
        raise ValueError("files must be able to hold pages: at least 200K")
    return size
