"""Nested JSON into related flat tables: an adjacency table of nodes, and entity tables pivoted from it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "node int, parent int, owner int, label string, ordinal int, kind string, scalar string, shape string, path string"
_ARROW = [("node", pa.int32()), ("parent", pa.int32()), ("owner", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("shape", pa.string()), ("path", pa.string())]
ROWS_OUT = 20_000


class Number(str):
    """A number as it is written."""


def _no_constant(text: str) -> None:
    raise ValueError(f"{text} is not JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))')


def _parse_deep(text: str):
    """Parse without recursion, for texts nested beyond the interpreter's stack."""
    at, end = 0, len(text.rstrip(" \t\n\r"))
    stack: list = []
    root: list = []
    put = root.append
    state = "value"
    key = None
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("not JSON")
        at = m.end()
        mark, string, number, word = m.groups()
        if state == "done":
            raise ValueError("text after the value")
        if mark in ("{", "["):
            if state not in ("value", "first-value"):
                raise ValueError("unexpected bracket")
            box: dict | list = {} if mark == "{" else []
            put(box)
            stack.append((box, put, key))
            state = "first-key" if mark == "{" else "first-value"
            put = box.append if mark == "[" else None
        elif mark in ("}", "]"):
            if not stack or isinstance(stack[-1][0], dict) != (mark == "}") or state not in ("next", "first-key" if mark == "}" else "first-value"):
                raise ValueError("unexpected end of a bracket")
            _, put, key = stack.pop()
            state = "next" if stack else "done"
        elif mark == ",":
            if state != "next" or not stack:
                raise ValueError("unexpected comma")
            state = "key" if isinstance(stack[-1][0], dict) else "value"
        elif mark == ":":
            if state != "colon":
                raise ValueError("unexpected colon")
            box = stack[-1][0]
            put = lambda v, box=box, key=key: box.__setitem__(key, v)
            state = "value"
        elif state in ("key", "first-key"):
            if string is None:
                raise ValueError("a key must be a string")
            key, state = json.loads(string), "colon"
        elif state in ("value", "first-value"):
            put(json.loads(string) if string is not None else Number(number) if number is not None else {"true": True, "false": False, "null": None}[word])
            state = "next" if stack else "done"
        else:
            raise ValueError("unexpected value")
    if state != "done":
        raise ValueError("text ends early")
    return root[0]


def _parse_one(text: str):
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)


def parse_json(text: str):
    """The JSON value of a text, numbers as written; a text that is a JSON string is read as the JSON within it.

    Raises ValueError for anything that isn't wholly valid JSON; of equal keys in an object the last counts.
    """
    value = _parse_one(text)
    return _parse_one(value) if type(value) is str else value


def _scalar(value) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if value is True or value is False:
        return "bool", "true" if value else "false"
    if isinstance(value, Number):
        return "number", str(value)
    return "string", value.encode("utf-8", "replace").decode() if not value.isascii() else value


def _clean(label: str | None) -> str | None:
    return label if label is None or label.isascii() else label.encode("utf-8", "replace").decode()


def nodes(value, only: str | None = None) -> Iterator[tuple]:
    """Rows of NODE for a parsed value, in document order, by an explicit stack.

    parent is the containing node, owner the nearest containing object; label is the key under which a value, or the
    array it is in, hangs on its owner; ordinal counts positions in an array from 0; shape is path with [] for every
    position. only='containers': just objects and arrays, without shape and path, which element_links gets from the links.
    """
    if only is not None and type(value) is not dict and type(value) is not list:
        return
    number = 0
    stack = [(value, None, None, None, None, "", "")]
    while stack:
        value, parent, owner, label, ordinal, shape, path = stack.pop()
        me, number = number, number + 1
        if type(value) is dict:
            yield me, parent, owner, label, ordinal, "object", None, shape, path
            if only is None:
                dot, sdot = (path + "." if path else ""), (shape + "." if shape else "")
                for k in reversed(value):
                    name = _clean(k)
                    stack.append((value[k], me, me, name, None, sdot + name, dot + name))
            else:
                stack.extend([(v, me, me, _clean(k), None, None, None) for k, v in reversed(value.items()) if type(v) is dict or type(v) is list])
        elif type(value) is list:
            yield me, parent, owner, label, ordinal, "array", None, shape, path
            if only is None:
                inner = shape + "[]"
                for i in range(len(value) - 1, -1, -1):
                    stack.append((value[i], me, owner, label, i, inner, f"{path}[{i}]"))
            else:
                stack.extend([(v, me, owner, label, i, None, None) for i, v in zip(range(len(value) - 1, -1, -1), reversed(value), strict=True) if type(v) is dict or type(v) is list])
        else:
            kind, text = _scalar(value)
            yield me, parent, owner, label, ordinal, kind, text, shape, path


def shred(df: DataFrame, record_id: str, text: str, only: str | None = None, shapes: tuple[str, ...] = (), fields: tuple[str, ...] = ()) -> DataFrame:
    """The adjacency table of a column of JSON texts: record_id, doc and the columns of NODE.

    doc is a hash of the text, so copies of a record share their nodes' keys and differing texts of a record don't.
    Null, empty, damaged and non-JSON texts have no rows. A null record_id is kept. shapes and fields keep only objects
    of those shapes and scalars of those labels (all without them). Columns of df beyond the two are not read; no
    shuffle; each text is parsed once and rows leave in batches, whatever a text's length.
    """
    src = df.where(F.col(text).isNotNull()).select(F.col(record_id).cast("string").alias("record_id"), F.xxhash64(text).alias("doc"), F.col(text).alias("text"))
    schema = pa.schema([("record_id", pa.string()), ("doc", pa.int64()), *_ARROW])
    keep_shapes, keep_fields = frozenset(shapes), frozenset(fields)

    def run(batches):
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for rid, doc, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    value = parse_json(body)
                except (ValueError, RecursionError):
                    continue
                for n in nodes(value, only):
                    if (keep_shapes or keep_fields) and (n[7] not in keep_shapes if n[5] == "object" else n[3] not in keep_fields):
                        continue
                    rows.append((rid, doc, *n))
                    if len(rows) >= ROWS_OUT:
                        yield flush()
        yield flush()

    return src.mapInArrow(run, f"record_id string, doc long, {NODE}")


def element_links(adjacency: DataFrame) -> DataFrame:
    """record_id, path of the objects in an adjacency table that are array elements, by following the links to their parents.

    The table is read as shred gives it, before any shuffle: the nodes of a text stand together, parents before their
    children, and the root begins a text. Only the links of one text are held at a time; a path is put together for an
    element alone, so texts of any depth cost no more than their elements' paths.
    """
    schema = pa.schema([("record_id", pa.string()), ("path", pa.string())])

    def run(batches):
        links: dict[int, tuple] = {}
        for batch in batches:
            records, out = [], []
            for i, (kind, node, parent, label, ordinal) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True)):
                if parent is None:
                    links = {node: (None, "")}
                    continue
                links[node] = (parent, f".{label}" if ordinal is None else f"[{ordinal}]")
                if ordinal is not None and kind == "object":
                    steps = []
                    while node is not None:
                        node, step = links[node]
                        steps.append(step)
                    path = "".join(reversed(steps))
                    records.append(i)
                    out.append(path[1:] if path[0] == "." else path)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(records, pa.int32())), pa.array(out, pa.string())], schema=schema)

    return adjacency.select("record_id", "kind", "node", "parent", "label", "ordinal").mapInArrow(run, "record_id string, path string")


def element_paths(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """src, record_id, path of every object that is an array's element; sources: name to (rows, id, JSON column).

    Each comes out once per record, whatever the record's copies. The paths come from the adjacency table of the
    containers; scalars are on no other node's path and have no rows in it here.
    """
    out = None
    for name, (df, rid, text) in sources.items():
        part = element_links(shred(df, rid, text, only="containers")).select(F.lit(name).alias("src"), "record_id", "path")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def objects(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """src, record_id, doc, node, parent_node, label, ordinal, shape, path, fields of every object, at any depth, once per record and text.

    sources: name to (rows, id, JSON column). node, label, ordinal, shape, path and doc are those of shred, parent_node
    is the nearest containing object (null at the root); fields maps the labels of the scalar children to their values
    as strings (null for null). An object that stands alone and one in an array differ in shape and ordinal only.
    """
    ddl = "src string, record_id string, doc long, node int, parent_node int, label string, ordinal int, shape string, path string, fields map<string, string>"
    types = [("src", pa.string()), ("record_id", pa.string()), ("doc", pa.int64()), ("node", pa.int32()), ("parent_node", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("shape", pa.string()), ("path", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]
    schema = pa.schema(types)

    def run(batches):
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for src, rid, doc, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    value = parse_json(body)
                except (ValueError, RecursionError):
                    continue
                fields: dict[int, dict] = {}
                found = []
                for me, _, owner, label, ordinal, kind, scalar, shape, path in nodes(value):
                    if kind == "object":
                        fields[me] = {}
                        found.append((me, owner, label, ordinal, shape, path))
                    elif kind != "array" and ordinal is None and owner is not None:
                        fields[owner][label] = scalar
                for o in found:
                    rows.append((src, rid, doc, *o, list(fields[o[0]].items())))
                    if len(rows) >= ROWS_OUT:
                        yield flush()
        yield flush()

    out = None
    for name, (df, rid, text) in sources.items():
        own = df.where(F.col(text).isNotNull()).select(F.lit(name).alias("src"), F.col(rid).cast("string").alias("record_id"), F.xxhash64(text).alias("doc"), F.col(text).alias("text"))
        part = own.mapInArrow(run, ddl)
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["src", "record_id", "doc", "node"])


def entity_tables(found: DataFrame, most: int = 10_000) -> dict[tuple[str, str], DataFrame]:
    """A flat table for each source and shape of objects(): record_id, doc, node, parent_node, ordinal, path and a column f_LABEL for each scalar label met.

    The shapes and labels are collected, as many as the sources' schema has; more than most raise ValueError. Cut or
    persist found before if many tables are read.
    """
    met = found.select("src", "shape", F.explode_outer(F.map_keys("fields")).alias("label")).distinct().limit(most + 1).collect()
    if len(met) > most:
        raise ValueError(f"more than {most} shapes and labels")
    labels: dict[tuple[str, str], list[str]] = {}
    for src, shape, label in met:
        labels.setdefault((src, shape), []).extend([label] if label is not None else [])
    keys = ("record_id", "doc", "node", "parent_node", "ordinal", "path")
    return {(src, shape): found.where((F.col("src") == src) & (F.col("shape") == shape)).select(*keys, *(F.try_element_at("fields", F.lit(x)).alias(f"f_{x}") for x in sorted(own))) for (src, shape), own in labels.items()}


def entity_table(df: DataFrame, record_id: str, text: str, at: str, shape: str, fields: tuple[str, ...]) -> DataFrame:
    """One row per object of a shape (as 'tasks[].result[].items[]'), of each record's latest text.

    Columns: record_id, node, parent_node (the nearest containing object), ordinal, path and the scalar children named
    in fields as strings (null if absent, null or no scalar). Object nodes meet their scalar children in one grouping
    by node, which pivots the labels; the latest text of a record is the greatest (at, hash), chosen over narrow rows.
    """
    rows = shred(df, record_id, text, shapes=(shape,), fields=fields)
    is_object = F.col("kind") == "object"
    direct = ~is_object & F.col("ordinal").isNull()
    pick = lambda c: F.max(F.when(is_object, F.col(c))).alias(c)
    own = rows.where(is_object | direct).withColumn("of", F.when(is_object, F.col("node")).otherwise(F.col("owner")))
    wide = own.groupBy("record_id", "doc", "of").agg(pick("shape"), F.max(F.when(is_object, F.col("owner"))).alias("parent_node"), pick("ordinal"), pick("path"), *(F.max(F.when(direct & (F.col("label") == f), F.col("scalar"))).alias(f"f_{f}") for f in fields))
    last = df.where(F.col(text).isNotNull()).groupBy(F.col(record_id).cast("string").alias("record_id")).agg(F.max(F.struct(F.col(at).alias("at"), F.xxhash64(text).alias("doc"))).alias("last"))
    last = last.select("record_id", F.col("last.doc").alias("doc"))
    kept = wide.where(F.col("shape") == shape).join(last, ["record_id", "doc"], "left_semi")
    return kept.select("record_id", F.col("of").alias("node"), "parent_node", "ordinal", "path", *(F.col(f"f_{f}").alias(f) for f in fields))
