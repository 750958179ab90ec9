import gzip
import json

import pytest

from schemaloom.sources import readers, schemas, writers


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        (gzip.open(path, "wt") if name.endswith(".gz") else path.open("w")).write(text)
        return str(path)

    return write


def test_json_lines_keep_what_does_not_parse(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"text": "x"}\n{bad\n')
    rows = readers.json_lines(spark, str(tmp_path / "a.json.gz"), schemas.CORPUS).cache()
    assert rows.where("text = 'x'").count() == 1 and rows.where("_corrupt_record is not null").count() == 1


def test_array_and_keyed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([["d1", {"sentences": ["a", "b"]}], ["d2", {"sentences": []}]]))
    (tmp_path / "k.json").write_text(json.dumps({"x": 1.5, "y": 2}))
    assert sorted((r["id"], r["sentences"]) for r in readers.json_array(spark, str(tmp_path / "a.json")).collect()) == [("d1", ["a", "b"]), ("d2", [])]
    assert dict(readers.keyed_object(spark, str(tmp_path / "k.json"), "double").collect()) == {"x": 1.5, "y": 2.0}


PAGE = "<page><title>{t}</title><ns>0</ns><id>{i}</id>{r}<revision><id>{v}</id><text>{x}</text></revision></page>"


def test_wiki_dump(spark, tmp_path):
    pages = [PAGE.format(t="A", i=1, r="", v=11, x="body"), PAGE.format(t="File:B", i=2, r="", v=12, x="b"), PAGE.format(t="Help:C", i=3, r='<redirect title="A"/>', v=13, x="c"), PAGE.format(t="Template:T", i=4, r="", v=14, x="#REDIRECT [[Template:U]]")]
    (tmp_path / "d.xml").write_text("<mediawiki><siteinfo><sitename>S</sitename><base>b</base><namespaces><namespace>Talk</namespace></namespaces></siteinfo>" + "".join(pages) + "</mediawiki>")
    path = str(tmp_path / "d.xml")
    assert [(r["id"], r["revid"], r["url"]) for r in readers.wiki_dump(spark, path, ("Help",), "u").collect()] == [("1", "11", "u?curid=1")]
    assert readers.wiki_templates(spark, path).first()["target"] == "Template:U"
    assert readers.site_info(spark, path).first()["namespaces"] == ["Talk"]


def test_pages_that_repeat_the_one_before(spark, tmp_path):
    pages = [("A", 1), ("A", 1), ("Help:C", 3), ("Help:C", 3), ("Help:D", 4), ("Help:C", 3)]
    (tmp_path / "d.xml").write_text("<mediawiki>" + "".join(PAGE.format(t=t, i=i, r="", v=10 + n, x="x") for n, (t, i) in enumerate(pages)) + "</mediawiki>")
    assert sorted(r["revid"] for r in readers.wiki_pages(spark, str(tmp_path / "d.xml"), ("Help",)).collect()) == ["10", "11", "12", "14", "15"]


def test_news_xml(spark, tmp_path):
    (tmp_path / "2001/x").mkdir(parents=True)
    (tmp_path / "2001/x/a.xml").write_text("<nitf><title>T</title><hl1>H</hl1><p> one </p><p>two</p></nitf>")
    row = readers.news_xml(spark, str(tmp_path)).first()
    assert row["title"] == "T" and row["paragraphs"] == ["H", "one", "two"]


def test_completions_drop_the_unended_record(spark, tmp_path):
    (tmp_path / "o.txt").write_text("a\nb\n\n###\n\nc\nd\n\n###\n\nleft\n")
    assert [(r["record_no"], r["raw"]) for r in readers.completions(spark, str(tmp_path / "o.txt"), 1).orderBy("record_no").collect()] == [(0, "b"), (1, "d")]


def test_tables_and_blocks(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("run#VB\tsub\tobj#a#NN\t2.0\n#x\ts\to\t1.0\n")
    assert sorted(tuple(r) for r in readers.triple_table(spark, str(tmp_path / "t.tsv")).collect()) == [("#x", "s", "o", 1.0), ("run", "sub", "obj#a", 2.0)]
    assert readers.triple_table(spark, str(tmp_path / "t.tsv"), 1.5).count() == 1
    (tmp_path / "c.txt").write_text("3 w c r\nbad line\n")
    assert sorted((r["n"] or 0, r["valid"]) for r in readers.count_table(spark, str(tmp_path / "c.txt")).collect()) == [(0, False), (3, True)]
    (tmp_path / "f.txt").write_text("# Cluster 7\nPredicates: a, b\nSubjects: s\nObjects: \n# Cluster 8\nPredicates: c\nSubjects: t\nObjects: o\n")
    assert [(r["cid"], r["predicates"], r["objects"]) for r in readers.frame_blocks(spark, str(tmp_path / "f.txt")).orderBy("cid").collect()] == [("7", ["a", "b"], []), ("8", ["c"], ["o"])]
    (tmp_path / "g.txt").write_text("# F1: note\ns\tv\to\n# F2: note\ns2\tv2\to2\n")
    assert sorted(tuple(r) for r in readers.gold_frames(spark, str(tmp_path / "g.txt")).collect()) == [("F1", "s", "v", "o"), ("F2", "s2", "v2", "o2")]
    (tmp_path / "v.txt").write_text("1\t\tx\tgo run\n")
    assert readers.verb_classes(spark, str(tmp_path / "v.txt")).count() == 2
    (tmp_path / "n.txt").write_text("h\th\th\n<a, b, a>\t<s>\t<>\n")
    assert readers.set_triples(spark, str(tmp_path / "n.txt")).first()["predicates"] == ["a", "b"]
    (tmp_path / "r.tsv").write_text("id\tvote\tsubjects\tverbs\tobjects\n1\tyes\ts\tv\to\n2\t\ts\tv\to\n")
    assert readers.ratings(spark, str(tmp_path / "r.tsv")).count() == 1


def test_conll_heads(spark, tmp_path):
    line = "\t".join(["0", "dogs", "dog", "x", "NNS", "f", "g", "h", "nsubj|conj", "1|2"])
    (tmp_path / "s.conll").write_text(f"# Frame 1\n{line}\n\n")
    assert sorted((r["dep"], r["dst"]) for r in readers.conll(spark, str(tmp_path / "s.conll")).collect()) == [("conj", "2"), ("nsubj", "1")]


def test_read_or_build_builds_once(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert readers.read_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert built == [1]


def test_writers(spark, tmp_path):
    edges = spark.createDataFrame([(("a", "b"), "c", 1.0)], "a struct<x:string,y:string>, b string, w double")
    writers.edge_table(edges, str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).collect()[1][0].startswith("a|b\tc")
    pages = spark.createDataFrame([("1", "2", "u", "t", "x")], schemas.PAGE)
    writers.page_documents(pages, str(tmp_path / "p"), as_json=False)
    assert spark.read.text(str(tmp_path / "p"), wholetext=True).first()[0].startswith('<doc id="1" revid="2"')
    writers.frame_text(spark.createDataFrame([("7", "predicates", "b"), ("7", "predicates", "a"), ("7", "objects", "o")], "cluster string, role string, member string"), str(tmp_path / "f"))
    assert readers.frame_blocks(spark, str(tmp_path / "f")).first()["predicates"] == ["a", "b"]
    writers.json_lines(spark.range(5), str(tmp_path / "j"), per_file=2, compression="bzip2")
    assert spark.read.json(str(tmp_path / "j")).count() == 5
    writers.prompt_file(spark.createDataFrame([("x",)], "prompt string"), str(tmp_path / "q"))
    writers.word_vectors(spark.createDataFrame([("w", [1.0, 2.0])], schemas.VECTORS), str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).first()[0] == "w 1.0 2.0"
    assert writers.report(spark.range(1)).split() == ["id", "0"]
