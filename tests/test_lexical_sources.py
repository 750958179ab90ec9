import datetime
import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.operators import lexicon
from schemaloom.sources import lexical, readers, writers
from schemaloom.streaming import ingest


def test_vectors_of_both_layouts(spark, tmp_path):
    words = [("a", [3.0, 4.0]), ("b", [0.0, 0.0])]
    (tmp_path / "v.bin").write_bytes(b"2 2\n" + b"".join(w.encode() + b" " + struct.pack("<2f", *v) + b"\n" for w, v in words))
    (tmp_path / "v.txt").write_text("2 2\na 3.0 4.0\nb 0.0 0.0\n")
    for rows in (lexical.binary_vectors(spark, str(tmp_path / "v.bin")), lexical.text_vectors(spark, str(tmp_path / "v.txt"))):
        got = {r["word"]: r["vector"] for r in rows.collect()}
        assert got["a"] == pytest.approx([0.6, 0.8]) and got["b"] == [0.0, 0.0]
    writers.headed_vectors(lexical.text_vectors(spark, str(tmp_path / "v.txt"), unit=False), str(tmp_path / "w"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "w")).collect()]
    assert "3 2" in lines and any(x.startswith("[SUBJ] 1.0E-8") for x in lines)


def test_completions_of_large_files(spark, tmp_path):
    records = [f"v{i} o & e a{i}\nsecond {i}" for i in range(300)]
    (tmp_path / "c.txt").write_text("\n\n###\n\n".join(records) + "\n\n###\n\n" + "left over")
    (tmp_path / "d.txt").write_text("x y & e\nq\n\n###\n\nx y & f\nr\n\n###\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = lexical.completion_records(spark, str(tmp_path / "c.txt"))
        assert [(r["record_no"], r["raw"]) for r in rows.orderBy("record_no").collect()] == [(i, f"v{i} o & e a{i}") for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["raw"] for r in lexical.completion_records(spark, str(tmp_path / "d.txt"), 1).orderBy("record_no").collect()] == ["q", "r"]
    assert [tuple(r) for r in lexical.last_completions(lexical.completion_records(spark, str(tmp_path / "d.txt"))).collect()] == [("x y", "x y & f")]


BLOCK = """# RID: 1
# Frame "Claim"
#     FEE: 2
#     Owner: 3, 4
#     Bad: 9
1\tIt\tit\tpp\tPRP\t_\t_\t_\t2\tnsubj\t_
2\tclaims\tclaim\tvv\tVBZ\t_\t_\t_\t_\t_\t_
3\tbig\tbig\tjj\tJJ\t_\t_\t_\t4\tamod\t_
4\tland\tland\tnn\tNN\t_\t_\t_\t2|1\tdobj|dep\t_
short\tline"""


def test_dependency_sentences_with_frames(spark, tmp_path):
    (tmp_path / "s.conll").write_text(BLOCK + "\n\n" + BLOCK + "\n")
    lines = lexical.sentences(spark, str(tmp_path / "s.conll")).cache()
    assert lines.select("sentence").distinct().count() == 2  # equal sentences stay apart
    edges = lexical.dependencies(lines)
    assert edges.where("src = 4").count() == 4 and edges.where("dst is null").count() == 2
    roles = lexical.frame_roles(lines)
    assert {(r["frame"], r["role"], r["unit"]) for r in roles.collect()} == {("Claim", "FEE", "claim"), ("Claim", "Owner", "big land")} and roles.count() == 4
    units = lexicon.role_units(roles.select("frame", "role", "unit"))
    assert {(r["role"], r["units"]) for r in units.collect()} == {("FEE", "claim:2"), ("Owner", "big land:2")}


def test_frame_lexicon(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<doc><sentence><text>The fuel burns.</text><annotationSet ID="1"><layer name="FE"/></annotationSet><annotationSet frameID="2" frameName="Fire" luName="burn.v"><layer name="FE"><label start="4" end="7" name="Fuel"/><label name="Null"/></layer><layer name="GF"><label start="0" end="2" name="Ext"/></layer></annotationSet></sentence></doc>')
    assert sorted(tuple(r) for r in lexical.full_text_frames(spark, str(tmp_path / "t.xml")).collect()) == [("Fire", "FEE", "burn.v"), ("Fire", "Fuel", "fuel")]
    (tmp_path / "f.xml").write_text('<frames><frame name="A"><lexUnit name="go.v"/><lexUnit name="trip.n"/></frame><frame name="B"><lexUnit name="run.v"/></frame></frames>')
    (tmp_path / "r.xml").write_text('<frameRelations><frameRelationType name="Inheritance"><frameRelation superFrameName="A" subFrameName="B"/></frameRelationType><frameRelationType name="Using"><frameRelation superFrameName="B" subFrameName="A"/></frameRelationType></frameRelations>')
    units, relations = lexical.lexical_units(spark, str(tmp_path / "f.xml")), lexical.frame_relations(spark, str(tmp_path / "r.xml"))
    assert {(r["frame"], r["unit"]) for r in lexicon.with_children(units, relations).collect()} == {("A", "go.v"), ("A", "trip.n"), ("A", "run.v"), ("B", "run.v")}


def test_small_readers(spark, tmp_path):
    (tmp_path / "x/y").mkdir(parents=True)
    (tmp_path / "x/y/wiki_00").write_text('{"id": "1"}\n')
    assert [tuple(r) for r in lexical.json_tree(spark, str(tmp_path / "x"), "id string").collect()] == [("1", "y/wiki_00")]
    assert [r["text"] for r in lexical.piped_lines(spark, ["a\n", "b"]).collect()] == ["a", "b"]
    assert [r["id"] for r in lexical.first_rows(spark.range(9).repartition(3), ["id"], 2).collect()] == [0, 1]
    buffer = io.BytesIO()
    np.savez(buffer, data=np.array([1.0, 2.0, 3.0]), indices=np.array([0, 2, 1]), indptr=np.array([0, 2, 2, 3]))
    (tmp_path / "m.npz").write_bytes(buffer.getvalue())
    assert sorted(tuple(r) for r in lexical.compressed_rows(spark, str(tmp_path / "m.npz")).collect()) == [(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.0)]
    assert [lexical.byte_size(x) for x in ("0", "1M", "300k", "2G")] == [0, 1 << 20, 300 << 10, 2 << 30]
    with pytest.raises(ValueError):
        lexical.byte_size("10K")
    rows = spark.createDataFrame([("p", 2), ("p", 1), ("q", 3)], "predicate string, row int")
    assert [tuple(r) for r in lexical.indexed_by_predicate(rows).collect()] == [("p", 1), ("p", 2), ("q", 3)]


def test_small_writers(spark, tmp_path):
    out = lambda name: str(tmp_path / name)
    writers.with_sample(spark.range(20).repartition(4), out("s"), ["id"], 3)
    assert sorted(r["id"] for r in spark.read.json(out("s.sample")).collect()) == [0, 1, 2] and spark.read.json(out("s")).count() == 20
    writers.json_object(spark.createDataFrame([("b", 2.0), ("a", 1.0)], "k string, v double"), "k", "v", out("o"))
    assert spark.read.text(out("o")).first()[0] == '{"a":1.0,"b":2.0}'
    assert dict(readers.keyed_object(spark, out("o"), "double").collect()) == {"a": 1.0, "b": 2.0}
    pages = spark.createDataFrame([(f"{i:04}", "x" * 90) for i in range(350)], "id string, text string")
    writers.split_documents(pages, out("d"), most_bytes=300, compression="bzip2")
    read = spark.read.text(out("d")).select(F.get_json_object("value", "$.id").alias("id"), "folder", "file").collect()
    assert len(read) == 350 and {r["folder"] for r in read} == {"AA", "AB"} and max(r["file"] for r in read) == "wiki_99"
    placed = sorted((r["folder"], r["file"], r["id"]) for r in read)
    assert [x[2] for x in placed] == sorted(x[2] for x in placed)
    writers.topic_report(spark.createDataFrame([(7, "v o"), (7, "a b"), (9, "c d")], "cluster int, member string"), out("t"))
    assert sorted(r[0] for r in spark.read.text(out("t")).collect()) == ["Topic 0 (2): , a b, v o", "Topic 1 (1): , c d"]
    writers.vocabulary(spark.createDataFrame([("a", 1), ("b", 5)], "term string, n long"), out("v"), counts=True)
    assert {(r["term"], r["n"]) for r in lexical.vocabulary(spark, out("v")).collect()} == {("b", 5), ("a", 1)}
    writers.coo_matrix(spark.createDataFrame([(0, 1, 2.0), (0, 2, 0.0)], "row long, col long, value double"), out("m"))
    assert [tuple(r) for r in lexical.coo_matrix(spark, out("m")).collect()] == [(0, 1, 2.0)]
    writers.feature_table(spark.createDataFrame([("w", [1.0])], "word string, vector array<double>"), out("f"))
    writers.bootstrap_samples(spark.range(3), out("b"))
    assert spark.read.parquet(out("f")).first()["vector"] == [1.0] and spark.read.parquet(out("b")).count() == 3
    rows = spark.createDataFrame([("intra", 1, '{"input":"v o","pred_slots":["a"]}'), ("final", 0, '{"input":"c"}')], "target string, number int, record string")
    writers.annotation_file(rows, out("a"))
    assert any('"pred_slots":["a"]' in r[0] for r in spark.read.text(out("a")).collect())
    (tmp_path / "x.nmpu").write_text("0.5  0.6 0.7\nmore\n")
    assert [tuple(r) for r in writers.collected_reports(spark, out("x.nmpu")).collect()] == [("x.nmpu", "0.5\t0.6\t0.7")]


def test_late_rows_are_kept_apart(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([(1, now - datetime.timedelta(hours=3), now), (2, now, now)], "i int, arrived_at timestamp, _seen_at timestamp")
    assert [r["i"] for r in ingest.too_late(rows).collect()] == [1]
