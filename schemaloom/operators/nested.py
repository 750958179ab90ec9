"""Deeply nested records as related flat tables.

Every element of every array in a record is a node. A depth-first traversal gives each node its pre-order and
post-order number; a node lies below another exactly if its interval lies inside the other's. The traversal
runs on Arrow list offsets: subtree sizes bottom-up, numbers top-down, one numpy pass per level and batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = "record"


@dataclass
class NodeType:
    """One array: its name, its place in the parent (names of the structs on the way, none for an array in an array), its
    plain fields and the arrays below it."""

    name: str
    path: tuple[str, ...]
    kind: T.DataType
    fields: list[T.StructField]
    below: list["NodeType"] = field(default_factory=list)

    def walk(self) -> Iterator["NodeType"]:
        yield self
        for child in self.below:
            yield from child.walk()


def element_of(kind: T.DataType) -> T.DataType | None:
    """What an array or map holds; a map holds structs of ``key`` and ``value``. None for other types."""
    if isinstance(kind, T.MapType):
        return T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
    return kind.elementType if isinstance(kind, T.ArrayType) else None


def is_nested(kind: T.DataType) -> bool:
    """Whether an array or map has nodes: it holds structs, or arrays that do. Arrays of plain values are plain fields."""
    inside = element_of(kind)
    return isinstance(inside, T.StructType) or inside is not None and is_nested(inside)


def plain_kind(kind: T.DataType) -> T.DataType | None:
    """``kind`` without what becomes nodes of its own; None if nothing is left."""
    if isinstance(kind, T.StructType):
        kept = [T.StructField(f.name, p) for f in kind.fields if (p := plain_kind(f.dataType)) is not None]
        return T.StructType(kept) if kept else None
    return None if is_nested(kind) else kind


def node_types(schema: T.StructType) -> list[NodeType]:
    """The tree of arrays in ``schema``, also inside structs, maps and arrays; those of the same name get their path as prefix."""
    used: set[str] = {ROOT}

    def of(struct: T.StructType, path: str, way: tuple[str, ...] = ()) -> list[NodeType]:
        found = []
        for f in struct.fields:
            if isinstance(f.dataType, T.StructType):
                found += of(f.dataType, f"{path}_{f.name}", (*way, f.name))
            elif is_nested(f.dataType):
                found.append(node(f.name, f.dataType, path, (*way, f.name)))
        return found

    def node(name: str, kind: T.DataType, path: str, way: tuple[str, ...]) -> NodeType:
        name = name if name not in used else f"{path}_{name}"
        used.add(name)
        inside = element_of(kind)
        if not isinstance(inside, T.StructType):  # an array of arrays: its elements have no fields, only their own elements
            return NodeType(name, way, kind, [], [node("element", inside, name, ())])
        kept = plain_kind(inside)
        return NodeType(name, way, kind, kept.fields if kept else [], of(inside, name))

    return of(schema, ROOT)


def as_list(values: pa.Array) -> pa.Array:
    """A map as a list of its entries."""
    if pa.types.is_map(values.type):
        entry = pa.struct([("key", values.type.key_type), ("value", values.type.item_type)])
        return values.cast(pa.list_(entry))
    return values


def reached(values: pa.Array, path: tuple[str, ...]) -> pa.Array:
    for name in path:
        values = pc.struct_field(values, name)
    return as_list(values)


def pruned(values: pa.Array, kind: T.DataType) -> pa.Array:
    """``values`` with the fields of ``kind`` alone."""
    if not isinstance(kind, T.StructType):
        return values
    parts = [pruned(pc.struct_field(values, f.name), f.dataType) for f in kind.fields]
    return pa.StructArray.from_arrays(parts, names=[f.name for f in kind.fields], mask=pc.is_null(values))


def shred(df: DataFrame, record: str) -> DataFrame:
    """All nodes of ``df`` with interval labels.

    ``record`` names the column that identifies a row (unique, not null). Columns out: ``record``,
    ``node_type``, ``pre``, ``post`` (numbers within the record; the record itself is the root 0), ``depth``,
    ``pos`` (place in its array, from 0), ``present`` (false for a null element, which keeps its place) and,
    per node type with any, a struct of its plain fields, null on nodes of other types. Arrays inside structs, entries
    of maps and arrays in arrays are nodes too (``node_types``). A null or empty array has no nodes. Plain columns of
    ``df`` stay out; join them by ``record``.
    """
    forest = node_types(df.schema)
    kinds = [t for top in forest for t in top.walk()]
    labels = "record string, node_type string, pre bigint, post bigint, depth int, pos int, present boolean"
    schema = T._parse_datatype_string(labels)
    with_fields = [t for t in kinds if t.fields]
    for t in with_fields:
        schema.add(t.name, T.StructType(t.fields))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            levels: list[tuple[NodeType, dict]] = []

            def down(t: NodeType, lists: pa.Array, parent: dict, depth: int) -> dict:
                count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = pc.list_flatten(lists)
                begin = np.concatenate([[0], np.cumsum(count)])
                up = np.repeat(np.arange(len(count)), count)
                node = {"values": values, "begin": begin, "up": up, "parent": parent, "depth": depth, "row": parent["row"][up]}
                levels.append((t, node))
                node["below"] = [down(c, reached(values, c.path), node, depth + 1) for c in t.below]
                return node

            root = {"row": np.arange(rows), "depth": 0}
            root["below"] = [down(t, reached(batch.column(t.path[0]), t.path[1:]), root, 1) for t in forest]

            def sizes(node: dict, n: int) -> None:
                size = np.ones(n, np.int64)
                for child in node["below"]:
                    sizes(child, len(child["up"]))
                    total = np.concatenate([[0], np.cumsum(child["size"])])
                    child["before"] = total
                    size += total[child["begin"][1:]] - total[child["begin"][:-1]]
                node["size"] = size

            def number(node: dict) -> None:
                used = np.zeros(len(node["pre"]), np.int64)
                for child in node["below"]:
                    up, total, begin = child["up"], child["before"], child["begin"]
                    child["pre"] = node["pre"][up] + 1 + used[up] + total[:-1] - total[begin[up]]
                    child["pos"] = np.arange(len(up)) - begin[up]
                    used += total[begin[1:]] - total[begin[:-1]]
                    number(child)

            sizes(root, rows)
            root["pre"] = np.zeros(rows, np.int64)
            number(root)
            record_ids = batch.column(record)
            if arrow is None:
                arrow = {t.name: pa.struct([(f.name, pruned(pc.struct_field(n["values"], f.name), f.dataType).type) for f in t.fields]) for t, n in levels if t.fields}

            def emit(name: str, node: dict, pos: np.ndarray, present: np.ndarray, payload: pa.Array | None) -> pa.RecordBatch:
                n = len(pos)
                post = node["pre"] + node["size"] - 1 - node["depth"]
                columns = [
                    record_ids.take(pa.array(node["row"])), pa.array([name] * n, pa.string()), pa.array(node["pre"]),
                    pa.array(post), pa.array(np.full(n, node["depth"], np.int32)), pa.array(pos.astype(np.int32)), pa.array(present),
                ]
                columns += [payload if t.name == name else pa.nulls(n, arrow[t.name]) for t in with_fields]
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            yield emit(ROOT, root, np.zeros(rows), np.ones(rows, bool), None)
            for t, node in levels:
                values = node["values"]
                if not len(values):
                    continue
                present = pc.is_valid(values).to_numpy(zero_copy_only=False)
                payload = None
                if t.fields:
                    parts = [pruned(pc.struct_field(values, f.name), f.dataType) for f in t.fields]
                    payload = pa.StructArray.from_arrays(parts, fields=list(arrow[t.name]), mask=pa.array(~present))
                yield emit(t.name, node, node["pos"], present, payload)

    narrow = df.select(F.col(record).cast("string").alias(record), *dict.fromkeys(t.path[0] for t in forest))
    return narrow.mapInArrow(traverse, schema)


def node_table(nodes: DataFrame, node_type: str) -> DataFrame:
    """The flat table of one node type: labels and the type's own fields."""
    own = nodes.where(F.col("node_type") == node_type)
    return own.select("record", "pre", "post", "depth", "pos", "present", *([f"{node_type}.*"] if node_type in nodes.columns else []))


def enclosing(node_type: str, *wanted: str) -> Column:
    """Of each node, the fields ``wanted`` of the nearest ``node_type`` node whose interval contains it.

    Siblings' intervals don't overlap, so the only candidate is the last such node at or before it in
    pre-order: one sorted pass instead of a join on every pair of intervals.
    """
    before = Window.partitionBy("record").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    held = F.struct(F.col("post").alias("_post"), *wanted)
    last = F.last(F.when(F.col("node_type") == node_type, held), ignorenulls=True).over(before)
    return F.when(last["_post"] > F.col("post"), last)


def same_id(identifier: Column) -> Column:
    """Identifiers compare without case and outer white space."""
    return F.lower(F.regexp_replace(identifier, r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$", ""))


def linked_arguments(nodes: DataFrame, event: str, argument: str, entity: str | None = None, ref: str = "entity_id", key: str = "id") -> DataFrame:
    """One row per present argument of a present event: ``record, event_no, arg_no, ent_no, pre, post`` and the argument's fields.

    ``ent_no`` is the first entity of the record whose ``key`` equals the argument's ``ref``; -1 where there is
    none, the argument has no id, or there are no entities.
    """
    within = nodes.withColumn("_event", enclosing(event, "pos", "present"))
    if entity is None:
        return within.where((F.col("node_type") == argument) & F.col("present") & F.col("_event.present")).select(
            "record", F.col("_event.pos").alias("event_no"), F.col("pos").alias("arg_no"), F.lit(-1).alias("ent_no"), "pre", "post", f"{argument}.*"
        )
    wanted = F.when(F.col("node_type") == argument, same_id(F.col(argument)[ref])).otherwise(same_id(F.col(entity)[key]))
    same = Window.partitionBy("record", "_ref")
    found = F.min(F.when((F.col("node_type") == entity) & F.col("present"), F.col("pos"))).over(same)
    linked = within.where(F.col("node_type").isin(argument, entity)).withColumn("_ref", wanted)
    linked = linked.withColumn("ent_no", F.when(F.col("_ref").isNull(), -1).otherwise(F.coalesce(found, F.lit(-1))))
    return linked.where((F.col("node_type") == argument) & F.col("present") & F.col("_event.present")).select(
        "record", F.col("_event.pos").alias("event_no"), F.col("pos").alias("arg_no"), F.col("ent_no").cast("int").alias("ent_no"), "pre", "post", f"{argument}.*"
    )
