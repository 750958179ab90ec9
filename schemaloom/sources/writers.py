"""Writers of the output formats. All but the reports write in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaloom.operators.ranking import ranked


def json_lines(df: DataFrame, path: str, per_file: int | None = None, compression: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    if compression:
        writer = writer.option("compression", compression)
    writer.json(path)


def prompt_file(prompts: DataFrame, path: str) -> None:
    """Prompts with a blank line after each."""
    prompts.select("prompt").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def edge_table(edges: DataFrame, path: str) -> None:
    """``a, b, w`` with a header, tab-separated; struct nodes become ``a|b|c``."""
    kinds = dict(edges.dtypes)
    node = lambda c: F.concat_ws("|", f"{c}.*") if kinds[c].startswith("struct") else F.col(c)
    edges.select(node("a").alias("a"), node("b").alias("b"), "w").write.mode("overwrite").option("header", "true").csv(path, sep="\t")


def word_vectors(vectors: DataFrame, path: str) -> None:
    """Lines ``word x y z ...``."""
    vectors.select(F.concat_ws(" ", "word", F.array_join(F.transform("vector", lambda x: x.cast("string")), " "))).write.mode("overwrite").text(path)


def frame_text(members: DataFrame, path: str) -> None:
    """Frames as blocks of text from ``cluster, role, member`` (roles predicates, subjects, objects)."""
    joined = members.groupBy("cluster").pivot("role", ["predicates", "subjects", "objects"]).agg(F.array_join(F.array_sort(F.collect_set("member")), ", "))
    block = F.format_string("# Cluster %s\nPredicates: %s\nSubjects: %s\nObjects: %s\n", F.col("cluster").cast("string"), *(F.coalesce(c, F.lit("")) for c in ("predicates", "subjects", "objects")))
    joined.select(block).write.mode("overwrite").text(path)


def page_documents(pages: DataFrame, path: str, as_json: bool = True) -> None:
    """Pages as JSON lines or as ``<doc ...>`` text."""
    if as_json:
        pages.select(F.to_json(F.struct("id", "revid", "url", "title", "text"))).write.mode("overwrite").text(path)
        return
    head = F.format_string('<doc id="%s" revid="%s" url="%s" title="%s">\n%s\n</doc>\n', "id", "revid", "url", "title", "text")
    pages.select(head).write.mode("overwrite").text(path)


def coo_matrix(cells: DataFrame, path: str) -> None:
    cells.select("row", "col", "value").where("value <> 0").write.mode("overwrite").parquet(path)


def report(df: DataFrame, most: int = 200) -> str:
    """A fixed-width table of the first ``most`` rows, for reading."""
    rows = [[str(c) for c in df.columns]] + [["" if v is None else str(v) for v in r] for r in df.limit(most).collect()]
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in rows)


def with_sample(df: DataFrame, path: str, order: list[str], n: int = 5000) -> None:
    """JSON lines at ``path`` and the first ``n`` rows in ``order`` at ``path.sample``."""
    json_lines(df, path)
    json_lines(df.orderBy(*order).limit(n), f"{path}.sample")


def json_object(df: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON object with sorted keys, as one text row: for resources small enough to be such a file."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value")))))
    df.where(F.col(key).isNotNull()).agg(F.to_json(entries)).coalesce(1).write.mode("overwrite").text(path)


def feature_table(df: DataFrame, path: str) -> None:
    """Rows with vectors, arrays kept as arrays."""
    df.write.mode("overwrite").parquet(path)


def folder_name(number: Column) -> Column:
    """AA, AB, ... ZZ for 0, 1, ..."""
    letter = lambda n: F.char(F.lit(65) + n)
    return F.concat(letter((F.floor(number / 26) % 26).cast("int")), letter((number % 26).cast("int")))


def split_documents(pages: DataFrame, path: str, most_bytes: int = 1 << 20, order: str = "id", compression: str | None = None, files_a_folder: int = 100) -> None:
    """Pages as JSON lines in files of about ``most_bytes``, a hundred a folder: ``folder=AA/file=wiki_00`` and on.

    Pages stay in order; a page goes to the file that its first byte falls into, so files are written in parallel.
    """
    rows = pages.select(F.col(order).alias("_order"), F.to_json(F.struct(*pages.columns)).alias("value")).withColumn("_size", F.octet_length("value") + 1)
    numbered = ranked(rows, [], [F.col("_order")], "_n")
    part = F.floor(F.col("_n") / 10_000)
    sums = numbered.groupBy(part.alias("_part")).agg(F.sum("_size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for ten thousand pages
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy("_part").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.withColumn("_part", part).withColumn("_inside", inside).join(sums.select("_part", before.alias("_before")), "_part")
    file = F.floor((F.col("_before") + F.col("_inside")) / most_bytes)
    placed = placed.select("value", "_n", folder_name(F.floor(file / files_a_folder)).alias("folder"), F.format_string("wiki_%02d", (file % files_a_folder).cast("int")).alias("file"))
    writer = placed.repartition("folder", "file").sortWithinPartitions("folder", "file", "_n").select("value", "folder", "file").write.mode("overwrite").partitionBy("folder", "file")
    (writer.option("compression", compression) if compression else writer).text(path)


def annotation_file(rows: DataFrame, path: str) -> None:
    """Rows to be judged (``target, number, record``) as JSON lines ``{target, number, record}`` in the order of their numbers."""
    rows.orderBy("target", "number").select(F.to_json(F.struct("target", "number", F.from_json("record", "input string, pred_type string, all_slots array<string>, pred_slots array<string>, score double").alias("record")))).write.mode("overwrite").text(path)


def topic_report(members: DataFrame, path: str) -> None:
    """Lines ``Topic i (n): , a, b`` of clusters (``cluster, member``), the largest first; a cluster's line holds all its members."""
    lists = members.groupBy("cluster").agg(F.array_sort(F.collect_list("member")).alias("m"))
    rows = ranked(lists.withColumn("n", F.size("m")), [], [F.desc("n"), F.col("cluster")], "_n")
    line = F.concat(F.format_string("Topic %d (%d): ", F.col("_n") - 1, F.col("n")), F.array_join(F.transform("m", lambda x: F.concat(F.lit(", "), x)), ""))
    rows.select("_n", line.alias("value")).orderBy("_n").select("value").write.mode("overwrite").text(path)


# Fixed value: the subject of triples that have none, and the value of its vector's coordinates.
NO_SUBJECT, NO_SUBJECT_VALUE = "[SUBJ]", 1e-8


def headed_vectors(vectors: DataFrame, path: str) -> None:
    """``word x y ...`` under a line with the number of vectors and their size, with a vector for NO_SUBJECT."""
    extra = vectors.limit(1).select(F.lit(NO_SUBJECT).alias("word"), F.transform("vector", lambda _: F.lit(NO_SUBJECT_VALUE)).alias("vector"))
    every = vectors.select("word", F.transform("vector", lambda x: x.cast("double")).alias("vector")).unionByName(extra)
    head = every.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("k")).select(F.lit(0).alias("_o"), F.concat_ws(" ", "n", "k").alias("value"))
    lines = every.select(F.lit(1).alias("_o"), F.concat_ws(" ", "word", F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")).alias("value"))
    head.unionByName(lines).orderBy("_o", "value").select("value").write.mode("overwrite").text(path)


def bootstrap_samples(draws: DataFrame, path: str) -> None:
    """Scores of the draws, a row a draw, so that a test of significance can read them again."""
    draws.write.mode("overwrite").parquet(path)


def vocabulary(terms: DataFrame, path: str, counts: bool = False) -> None:
    """Terms, or terms and their counts, a line each: the most frequent first."""
    line = F.concat_ws(" ", "term", F.col("n").cast("string")) if counts else F.col("term")
    terms.orderBy(F.desc("n"), "term").select(line.alias("value")).write.mode("overwrite").text(path)


def collected_reports(spark: SparkSession, paths: str) -> DataFrame:
    """``file, fields``: the first line of each report, its fields parted at blanks, under the file's name."""
    rows = spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.split_part("value", F.lit("\n"), F.lit(1)).alias("line"))
    return rows.select("file", F.regexp_replace(F.trim("line"), r"\s+", "\t").alias("fields"))
