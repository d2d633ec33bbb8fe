"""Deeply nested semi-structured records to related flat tables, over an adjacency table of their nodes."""

from __future__ import annotations

import ast
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom import scratch

NODE_SCHEMA = "record_id long, node int, parent int, label string, ord int, kind string, scalar string, size int, path string, holder int"

# fixed values: the test groups and outcomes of a report, and the flags that mark a report without a task name
GROUPS = ("FAIL_TO_PASS", "PASS_TO_PASS", "FAIL_TO_FAIL", "PASS_TO_FAIL")
OUTCOMES = ("success", "failure")
REPORT_FIELDS = ("resolved", "tests_status", "patch_is_None", "patch_exists", "patch_successfully_applied")


def read_value(text: str | None):
    """The value of a whole JSON or Python literal, also wrapped in strings or behind byte order marks; else None.

    However often it is wrapped: what a string wraps is shorter than the string, so unwrapping ends.
    """
    value = text
    while isinstance(value, str):
        plain = value.strip().lstrip("\ufeff").strip()
        try:
            value = json.loads(plain)
        except (ValueError, RecursionError):
            try:
                value = ast.literal_eval(plain)
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                return None
    return value


def scalar_text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else repr(value)


def _kind(value) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, (list, tuple, set, frozenset)):
        return "array"
    if value is None:
        return "null"
    return "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"


class Nodes:
    """The columns of the adjacency table, filled record by record."""

    def __init__(self):
        self.columns: tuple[list, ...] = tuple([] for _ in NODE_SCHEMA.split(","))

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, record, value) -> None:
        """Every node of a record, parents first; the root is node 0 with parent -1. Members of an array without inner
        nodes, most of all nodes, are added at once. path is the labels of the three nodes above, from the top, with *
        for none; holder is the node above those, -1 if there is none."""
        ids, nodes, parents, labels, ords, kinds, scalars, sizes, paths, holders = self.columns
        todo, n = [(value, -1, None, 0, ("*", "*", "*"), (-1, -1, -1))], 0
        while todo:
            value, parent, label, ord_, names, above = todo.pop()
            kind, node = _kind(value), n
            n += 1
            inner = kind in ("object", "array")
            ids.append(record), nodes.append(node), parents.append(parent), labels.append(label), ords.append(ord_), kinds.append(kind)
            scalars.append(None if inner else scalar_text(value)), sizes.append(len(value) if inner else 0)
            paths.append("/".join(names)), holders.append(above[0])
            if not inner:
                continue
            # above: the third, second and first node over this one; under it, this one is the first
            names, above = (*names[1:], "*" if label is None else label), (above[1], above[2], parent)
            if kind == "object":
                todo += [(v, node, scalar_text(k), i, names, above) for i, (k, v) in reversed(list(enumerate(value.items())))]
                continue
            size = len(value)
            if all(type(v) is str for v in value):
                ids.extend([record] * size), nodes.extend(range(n, n + size)), parents.extend([node] * size), labels.extend([None] * size)
                ords.extend(range(size)), kinds.extend(["string"] * size), scalars.extend(value), sizes.extend([0] * size)
                paths.extend(["/".join(names)] * size), holders.extend([above[0]] * size)
                n += size
            else:
                todo += [(v, node, None, i, names, above) for i, v in reversed(list(enumerate(value)))]

    def batch(self) -> pa.RecordBatch:
        """The columns as Arrow; half a surrogate pair, which no table can hold, becomes a question mark."""
        out = []
        for c, f in zip(self.columns, _ARROW):
            try:
                out.append(pa.array(c, f.type))
            except (UnicodeEncodeError, pa.ArrowInvalid):
                out.append(pa.array([x if x is None else x.encode("utf-8", "replace").decode() for x in c], f.type))
        return pa.RecordBatch.from_arrays(out, schema=_ARROW)


def walk(value) -> Iterator[tuple[int, int, str | None, int, str, str | None, int]]:
    """(node, parent, label, ord, kind, scalar, size) of every node of one value."""
    nodes = Nodes()
    nodes.add(0, value)
    return zip(*nodes.columns[1:8])


def shred(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """The adjacency table of nested records: a row per node with its parent, label, ordinal, kind, scalar, number of
    children, the labels of the three nodes above it, and the node that holds those.

    record_id must be an integer that tells records apart. What is no whole JSON or Python literal has no nodes, neither
    have null texts. Objects and arrays have no scalar; text scalars stand as written, true and false as such words.
    Node numbers are fixed by the record alone. A record is read inside one task; nothing else is gathered.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        for batch in batches:
            out = Nodes()
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if body is not None and (value := read_value(body)) is not None:
                    out.add(rid, value)
                if len(out) > 50_000:
                    yield out.batch()
                    out = Nodes()
            yield out.batch()

    return records.select(F.col(record_id).cast("long").alias("record_id"), F.col(text).cast("string").alias("body")).where("record_id is not null").mapInArrow(nodes, NODE_SCHEMA)


_ARROW = pa.schema([("record_id", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ord", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("size", pa.int32()), ("path", pa.string()), ("holder", pa.int32())])


def node_table(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """shred(), written once and ordered by label inside each file, so that a read for few labels skips most pages."""
    return scratch.table(shred(records, record_id, text).sortWithinPartitions("label"), "nodes")


def scalars(nodes: DataFrame, names: list[str]) -> DataFrame:
    """One row per object node with the named scalar children as columns `kind_x` and `x`: join and pivot in one pass."""
    of = nodes.where(F.col("label").isin(names) & ~F.col("kind").isin("object", "array"))
    return of.groupBy("record_id", F.col("parent").alias("node")).agg(*[F.max(F.when(F.col("label") == x, F.col(y))).alias(z) for x in names for y, z in (("scalar", x), ("kind", f"kind_{x}"))])


def report_entities(reports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(report_id, node, task_id, resolved): a row for each task's record inside a report, linked to its report and node.

    A record stands alone, under its task's name, or in a list `reports` with an instance_id. Empty records are none.
    """
    objects = nodes.where("kind = 'object' and size > 0")
    root = objects.where("node = 0").select("record_id", "node")
    top = nodes.where("parent = 0")
    has = top.groupBy("record_id").agg(F.max(F.col("label").isin(*REPORT_FIELDS)).alias("alone"), F.max(F.when((F.col("label") == "reports") & (F.col("kind") == "array"), F.col("node"))).alias("listed"))
    root = root.join(has, "record_id")
    alone = root.where("listed is null and alone").select("record_id", "node", F.lit(None).cast("string").alias("named"))
    named = objects.where("parent = 0").join(root.where("listed is null and not alone").select("record_id"), "record_id").select("record_id", "node", F.col("label").alias("named"))
    listed = objects.join(root.where("listed is not null").select("record_id", F.col("listed").alias("parent")), ["record_id", "parent"]).select("record_id", "node", F.lit(None).cast("string").alias("named"))
    records = alone.union(named).union(listed)
    values = scalars(nodes, ["resolved", "instance_id"])
    word = F.lower(F.trim("resolved"))
    state = F.when(word.isin("true", "1", "1.0"), "resolved").when(word.isin("false", "0", "0.0"), "unresolved").otherwise("unknown")
    known = reports.select(F.col("report_id").alias("record_id"), F.col("task_id").alias("filed"))
    out = records.join(values, ["record_id", "node"], "left").join(known, "record_id")
    return out.select(F.col("record_id").alias("report_id"), "node", F.coalesce("named", "instance_id", "filed").alias("task_id"), state.alias("state"))


def test_entities(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """(report_id, node, task_id, test_group, outcome, ord, test_name): a row for each named test, linked to its record."""
    paths = [f"tests_status/{g}/{o}" for g in GROUPS for o in OUTCOMES]
    entries = nodes.where(F.col("label").isNull() & F.col("path").isin(paths))  # members of arrays have no label
    place = ["record_id", "node", "holder", "path", "ord"]
    plain = entries.where("kind <> 'object'").select(*place, F.col("scalar").alias("test_name"))
    names = scalars(nodes.where("label = 'name'"), ["name"])
    inner = entries.where("kind = 'object'").join(names, ["record_id", "node"]).select(*place, F.col("name").alias("test_name"))
    held = records.select(F.col("report_id").alias("record_id"), F.col("node").alias("holder"), "task_id")
    out = plain.union(inner).where("test_name is not null and test_name <> ''").join(held, ["record_id", "holder"])
    part = F.split("path", "/")
    return out.select(F.col("record_id").alias("report_id"), F.col("holder").alias("record_node"), "node", "task_id", part[1].alias("test_group"), part[2].alias("outcome"), "ord", "test_name")


def flat_reports(reports: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(report_id, task_id, test_group, outcome, ord, test_name): a parent row per record, then a row per named test.

    Nameless entries (null, empty, objects without a name) keep their index and give no row. Reports that can't be read
    or are empty give nothing. report_id must be unique; other columns of reports are ignored.
    """
    nodes = node_table(reports, "report_id", "report") if nodes is None else nodes
    records = scratch.table(report_entities(reports, nodes), "records")
    parents = records.select("report_id", "task_id", F.lit("REPORT").alias("test_group"), F.col("state").alias("outcome"), F.lit(-1).alias("ord"), F.lit("").alias("test_name"))
    tests = test_entities(nodes, records).select("report_id", "task_id", "test_group", "outcome", "ord", "test_name")
    return parents.unionByName(tests)
