from schemaloom.operators.nested import linked_arguments, node_table, shred

SCHEMA = "rec string, id int, events array<struct<kind:string,trigger:struct<text:string>,args:array<struct<ref:string,role:string>>>>, ents array<struct<id:string>>"
ROWS = [
    ("a", 1, [{"kind": "x", "trigger": None, "args": [{"ref": " E1 ", "role": "r"}, None, {"ref": None, "role": None}]}, None, {"kind": "y", "trigger": {"text": "t"}, "args": None}], [{"id": "e0"}, {"id": "e1"}, {"id": "E1"}]),
    ("b", 2, None, None),
    ("c", 3, [], [None, {"id": None}]),
    ("d", 4, [{"kind": None, "trigger": None, "args": []}, {"kind": "z", "trigger": None, "args": [{"ref": "e9", "role": "q"}]}], []),
]


def traverse(row):
    """Plain recursive numbering."""
    out, counter = [], {"pre": 0, "post": 0}

    def visit(kind, pos, children, present):
        pre = counter["pre"]
        counter["pre"] += 1
        for child in children:
            visit(*child)
        out.append((row[0], kind, pre, counter["post"], pos, present))
        counter["post"] += 1

    events = [("events", i, [("args", j, [], a is not None) for j, a in enumerate((e or {}).get("args") or [])], e is not None) for i, e in enumerate(row[2] or [])]
    visit("record", 0, events + [("ents", i, [], e is not None) for i, e in enumerate(row[3] or [])], True)
    return out


def test_labels_equal_recursive_traversal(spark):
    nodes = shred(spark.createDataFrame(ROWS, SCHEMA), "rec")
    got = sorted((r["record"], r["node_type"], r["pre"], r["post"], r["pos"], r["present"]) for r in nodes.collect())
    assert got == sorted(x for row in ROWS for x in traverse(row))


def test_links(spark):
    nodes = shred(spark.createDataFrame(ROWS, SCHEMA), "rec")
    got = sorted(tuple(r) for r in linked_arguments(nodes, "events", "args", "ents", "ref", "id").select("record", "event_no", "arg_no", "ent_no").collect())
    assert got == [("a", 0, 0, 1), ("a", 0, 2, -1), ("d", 1, 0, -1)]


def test_tables_and_payload(spark):
    nodes = shred(spark.createDataFrame(ROWS, SCHEMA), "rec")
    events = {(r["record"], r["pos"]): r for r in node_table(nodes, "events").collect()}
    assert events["a", 2]["trigger"]["text"] == "t" and events["a", 0]["kind"] == "x" and not events["a", 1]["present"]


def test_empty_table(spark):
    assert shred(spark.createDataFrame([], SCHEMA), "rec").count() == 0


def test_sliced_batches(spark):
    """Many records in one partition, so Arrow hands over several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(f"r{i}", *ROWS[i % 4][1:]) for i in range(40)]
        got = sorted((r["record"], r["node_type"], r["pre"], r["post"], r["pos"], r["present"]) for r in shred(spark.createDataFrame(rows, SCHEMA).coalesce(1), "rec").collect())
        assert got == sorted(x for row in rows for x in traverse(row))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


DEEP = "rec string, box struct<name:string,items:array<struct<a:int,tag:struct<t:string,sub:array<struct<b:int>>>>>>, grid array<array<struct<c:int>>>, bag map<string,struct<v:int,more:array<struct<d:int>>>>, plain array<int>"
DEEP_ROWS = [
    ("r", ("n", [(1, ("x", [(5,), None])), None, (2, None)]), [[(7,), (8,)], None, []], {"k": (3, [(9,)]), "l": None}, [1, 2]),
    ("s", None, None, None, None),
]


def test_structs_maps_and_arrays_in_arrays(spark):
    nodes = shred(spark.createDataFrame(DEEP_ROWS, DEEP), "rec").cache()
    kinds = sorted((r["node_type"], r["depth"], r["pos"], r["present"]) for r in nodes.where("record = 'r'").collect())
    assert kinds == sorted([
        ("record", 0, 0, True), ("items", 1, 0, True), ("items", 1, 1, False), ("items", 1, 2, True), ("sub", 2, 0, True), ("sub", 2, 1, False),
        ("grid", 1, 0, True), ("grid", 1, 1, False), ("grid", 1, 2, True), ("element", 2, 0, True), ("element", 2, 1, True),
        ("bag", 1, 0, True), ("bag", 1, 1, True), ("more", 2, 0, True)])
    assert [(r["a"], r["tag"] and r["tag"]["t"]) for r in node_table(nodes, "items").where("present").orderBy("pos").collect()] == [(1, "x"), (2, None)]
    assert {(r["key"], r["value"] and r["value"]["v"]) for r in node_table(nodes, "bag").collect()} == {("k", 3), ("l", None)}
    assert [r["c"] for r in node_table(nodes, "element").orderBy("pos").collect()] == [7, 8] and node_table(nodes, "grid").count() == 3
    pre = [r["pre"] for r in nodes.where("record = 'r'").collect()]
    assert sorted(pre) == list(range(14)) and nodes.where("record = 's'").count() == 1
