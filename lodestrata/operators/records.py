"""Nested JSON records into flat tables that keep parent and child links.

Every object that is an element of an array becomes one record. A bottom-up
tree automaton classifies the shape of each record: its state is a function of
the states below it, arrays collapse to the set of their elements' states, so
order, length and repetition don't make new variants. Records of one
generalised path form a supertype; its variants are the automaton's states.
``subtype_table`` routes a path (or one variant of it) into a typed table that
keeps the supertype's keys and the link to the parent; ``typed_records`` puts
out the rows of all paths and variants at once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import spread

LINKS = ("field_name", "child_ptr", "parent_ptr", "path", "variant", "record", "fields")
#: Of one field of a typed record; the value stands in the column of its type, all others are null.
FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("bigint_value", T.LongType()), T.StructField("double_value", T.DoubleType()), T.StructField("boolean_value", T.BooleanType()), T.StructField("string_value", T.StringType())])
_QUOTED_OR_COMMENT = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\r\n]*|/\*.*?\*/', re.S)
_QUOTED_OR_COMMA = re.compile(r'"(?:[^"\\]|\\.)*"|,(?=[ \t\r\n]*[}\]])', re.S)
_BLANK = " \t\r\n"


def _reject(name: str):
    raise ValueError(f"{name} is no JSON")


def _strict(text: str):
    return json.loads(text, parse_int=_integer, parse_constant=_reject)


class _Int(str):
    """An integer literal of thousands of digits, kept as text."""


def _integer(digits: str):
    return int(digits) if len(digits) <= 1000 else _Int(digits)


def _relaxed(text: str) -> str:
    """``text`` without comments and trailing commas; what stands in strings stays."""
    text = _QUOTED_OR_COMMENT.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)

    def comma(m: re.Match) -> str:
        if m[0][0] == '"':
            return m[0]
        before = text[: m.start()].rstrip(_BLANK)[-1:] if m.start() < 64 else text[m.start() - 64 : m.start()].rstrip(_BLANK)[-1:]
        return m[0] if before in ("[", "{", ",", ":") else ""

    return _QUOTED_OR_COMMA.sub(comma, text)


def _load(text: str):
    text = text.removeprefix("﻿")
    try:
        return _strict(text)
    except ValueError:
        return _strict(_relaxed(text))


def parse_object(text: str | None) -> dict | None:
    """The JSON object that ``text`` is, or None.

    Comments, trailing commas and a byte order mark are allowed; a JSON string
    that holds the whole object counts as the object. Null, empty, cut off,
    otherwise broken or too deeply nested texts, and JSON that is no object,
    give None.
    """
    if not text or ("{" not in text):
        return None
    try:
        value = _load(text)
        if type(value) is str:
            value = _load(value)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


class ShapeAutomaton:
    """Bottom-up tree automaton over JSON values; its states are shapes.

    Transitions are memoised, so a shape met before costs one look-up. A
    state's name is a hash of its transition and so agrees between workers.
    """

    def __init__(self) -> None:
        self.states: dict[tuple, str] = {}

    def scalar(self, value) -> str:
        if value is None:
            return "null"
        if type(value) is bool:
            return "bool"
        return "int" if type(value) in (int, _Int) else "num" if type(value) is float else "str"

    def step(self, kind: str, below: tuple) -> str:
        key = (kind, below)
        state = self.states.get(key)
        if state is None:
            state = kind + hashlib.blake2b(repr(key).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
            self.states[key] = state
        return state


def _escape(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1") if "~" in token or "/" in token else token


def records_of(root: dict, automaton: ShapeAutomaton, with_record: bool = True, typed: bool = False) -> list[tuple]:
    """(child_ptr, parent_ptr, path, variant, record) of each object that is an array's element.

    If ``typed``, its fields (see ``_typed``) come in place of the record. The
    walk keeps its own stack: depth is bounded by the text alone.
    """
    # value, pointer, pointer of the enclosing record, generalised path, is a record, place of the container above, key there
    order: list[tuple] = []
    stack: list[tuple] = [(root, "", "", "", False, -1, None)]
    while stack:
        entry = stack.pop()
        value, ptr, owner, path, is_record, _, _ = entry
        place = len(order)
        order.append(entry)
        inner = ptr if is_record else owner
        if type(value) is dict:
            for key, child in value.items():
                if type(child) is dict or type(child) is list:
                    name = _escape(key)
                    stack.append((child, f"{ptr}/{name}", inner, f"{path}/{name}", False, place, key))
        else:
            for n, child in enumerate(value):
                if type(child) is dict or type(child) is list:
                    stack.append((child, f"{ptr}/{n}", inner, f"{path}/*", type(child) is dict, place, n))
    found = []
    below: list[dict] = [{} for _ in order]
    for place in range(len(order) - 1, -1, -1):
        value, ptr, owner, path, is_record, above, key = order[place]
        states = below[place]
        if type(value) is dict:
            state = automaton.step("o", tuple(sorted((k, states[k] if k in states else automaton.scalar(v)) for k, v in value.items())))
        else:
            state = automaton.step("a", tuple(sorted({states[n] if n in states else automaton.scalar(v) for n, v in enumerate(value)})))
        if above >= 0:
            below[above][key] = state
        if is_record:
            found.append((ptr, owner, path, state, _typed(value) if typed else _own(value) if with_record else None))
    found.reverse()
    return found


def _own(value: dict) -> str | None:
    """The record as JSON text; arrays that hold records are left to the child tables."""
    try:
        return json.dumps({k: v for k, v in value.items() if not _holds_records(v)}, ensure_ascii=False)
    except RecursionError:
        return None


def _holds_records(value) -> bool:
    stack = [value]
    while stack:
        x = stack.pop()
        if type(x) is list:
            if any(type(e) is dict for e in x):
                return True
            stack.extend(e for e in x if type(e) is list)
    return False


def _is_bigint(value) -> bool:
    return type(value) is int and -(2**63) <= value < 2**63


def _typed(value: dict) -> list[tuple]:
    """(name, type, bigint, double, boolean, string) of each field by name, as its JSON token tells.

    Arrays that hold records are left to the child tables. Other arrays and
    objects are of type ``json``, as their text; an integer beyond 64 bits is
    of type ``integer``, as its digits.
    """
    out = []
    for name in sorted(value):
        v = value[name]
        if v is None:
            out.append((name, "null", None, None, None, None))
        elif type(v) is bool:
            out.append((name, "boolean", None, None, v, None))
        elif _is_bigint(v):
            out.append((name, "bigint", v, None, None, None))
        elif type(v) is float:
            out.append((name, "double", None, v, None, None))
        elif type(v) is str:
            out.append((name, "string", None, None, None, v))
        elif type(v) in (int, _Int):
            out.append((name, "integer", None, None, None, str(v)))
        elif not _holds_records(v):
            try:
                out.append((name, "json", None, None, None, json.dumps(v, ensure_ascii=False)))
            except RecursionError:
                out.append((name, "json", None, None, None, None))
    return out


def flatten_records(df: DataFrame, keys: list[str], fields: dict[str, Column], with_record: bool = True, typed: bool = False) -> DataFrame:
    """One row for each JSON object that is an element of an array, at any depth.

    ``keys`` name columns of ``df`` that are carried along; ``fields`` maps a
    field's name to a string expression. Result: the keys (as strings), then
    field_name, child_ptr, parent_ptr (JSON Pointers, '' without a parent),
    path (child_ptr with ``*`` for places in arrays), variant and, if
    ``with_record``, record, or if ``typed``, fields instead. One scan, no shuffle; texts that are null, empty,
    broken or no object give no rows; a row that is delivered twice gives its
    records twice; null keys are kept; other columns of ``df`` aren't read.
    Keys must not be named as a result column (ValueError).
    """
    if clash := set(keys) & set(LINKS):
        raise ValueError(f"key columns clash with result columns: {sorted(clash)}")
    names, where = list(fields), [f"__{n}" for n in range(len(fields))]
    slim = df.select(*(F.col(k).cast("string").alias(k) for k in keys), *(e.alias(w) for w, e in zip(where, fields.values())))
    may_hold = reduce(lambda a, b: a | b, (F.col(w).rlike(r"\[|\\u005") for w in where))
    slim = slim.filter(may_hold)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*keys, *LINKS[:5], *(["record"] if with_record and not typed else [])]])
    if typed:
        schema.add("fields", T.ArrayType(FIELD))
    width = len(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShapeAutomaton()
        target = pa.schema([(f.name, _FIELDS if f.name == "fields" and typed else pa.string()) for f in schema])
        for batch in batches:
            rows: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns):
                key = values[: len(keys)]
                for name, text in zip(names, values[len(keys) :]):
                    if text and ("[" in text or "\\u005" in text) and (root := parse_object(text)) is not None:
                        rows.extend((*key, name, *r)[:width] for r in records_of(root, automaton, with_record, typed))
                if len(rows) >= 20_000:
                    yield _batch(rows, target)
                    rows = []
            if rows:
                yield _batch(rows, target)

    return spread(slim).mapInArrow(walk, schema)


def _clean(text: str | None) -> str | None:
    """Lone surrogates, which JSON escapes can make, as U+FFFD."""
    return text if text is None or text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_FIELD = pa.struct([("name", pa.string()), ("type", pa.string()), ("bigint_value", pa.int64()), ("double_value", pa.float64()), ("boolean_value", pa.bool_()), ("string_value", pa.string())])
_FIELDS = pa.list_(_FIELD)


def _array(values: Iterable, kind: pa.DataType) -> pa.Array:
    if kind == _FIELDS:
        flat = [f for fields in values for f in fields]
        parts = [_array(c, f.type) for c, f in zip(zip(*flat) if flat else [()] * len(_FIELD), _FIELD)]
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_FIELD)))
    try:
        return pa.array(values, kind)
    except (UnicodeEncodeError, pa.ArrowInvalid):
        return pa.array([_clean(x) for x in values], kind)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)


def variant_catalog(records: DataFrame) -> DataFrame:
    """field_name, path, variant, n_records: the variants of each supertype path and their sizes."""
    return records.groupBy("field_name", "path", "variant").agg(F.count(F.lit(1)).alias("n_records"))


def _kind(value) -> int:
    """0 null, 1 int, 2 number, 3 boolean, 4 anything else: quoted digits, integers beyond 64 bits."""
    if value is None:
        return 0
    if type(value) is bool:
        return 3
    return 1 if _is_bigint(value) else 2 if type(value) is float else 4


def _fields_of(record: str) -> dict:
    try:
        return json.loads(record, parse_int=_integer)
    except (ValueError, RecursionError):
        return {}


def _field_kinds(records: DataFrame) -> DataFrame:
    """(field_name, path, name, kind, n): how many fields of each kind, by their JSON tokens; a batch's are counted before they leave it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("field_name", pa.string()), ("path", pa.string()), ("name", pa.string()), ("kind", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            found = Counter((field, path, name, _kind(v)) for field, path, text in zip(*(c.to_pylist() for c in batch.columns)) for name, v in _fields_of(text).items())
            if found:
                yield _batch([(*k, n) for k, n in found.items()], target)

    return records.select("field_name", "path", "record").filter("record is not null").mapInArrow(count, "field_name string, path string, name string, kind int, n bigint")


def subtype_catalog(records: DataFrame) -> DataFrame:
    """(field_name, path, name, type, n_present, n_records, n_variants): the typed fields of each supertype path's table.

    The common fields are those with n_present = n_records. All by two
    aggregations; nothing comes to the driver.
    """
    sizes = records.groupBy("field_name", "path").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("variant").alias("n_variants"))
    fields = _field_kinds(records).groupBy("field_name", "path", "name").agg(F.sum("n").alias("n_present"), F.max("kind").alias("most"), F.min(F.when(F.col("kind") > 0, F.col("kind"))).alias("least"))
    typed = F.when(F.col("most") == 0, "string").when((F.col("most") == 2) & (F.col("least") >= 1), "double").when(F.col("most") != F.col("least"), "string").when(F.col("most") == 1, "bigint").when(F.col("most") == 3, "boolean").otherwise("string")
    return fields.join(sizes, ["field_name", "path"]).select("field_name", "path", "name", typed.alias("type"), "n_present", "n_records", "n_variants")


def subtype_schema(records: DataFrame, path: str, max_fields: int = 1000) -> T.StructType:
    """The typed fields that the records of ``path`` have in any variant.

    Types that differ between records widen: int to double, anything else to
    string. ``max_fields`` bounds what comes to the driver; the most frequent
    fields get columns, the text of the rest stays in ``record``.
    """
    found = (
        _field_kinds(records.filter(F.col("path") == path))
        .groupBy("name")
        .agg(F.sum("n").alias("n"), F.max("kind").alias("most"), F.min(F.when(F.col("kind") > 0, F.col("kind"))).alias("least"))
        .orderBy(F.desc("n"), "name")
        .limit(max_fields)
        .collect()
    )
    kinds = {1: T.LongType(), 2: T.DoubleType(), 3: T.BooleanType()}
    return T.StructType([T.StructField(r["name"], kinds.get(r["most"], T.StringType()) if r["most"] == r["least"] or (r["most"] == 2 and r["least"] == 1) else T.StringType()) for r in sorted(found, key=lambda r: r["name"])])


def subtype_table(records: DataFrame, path: str, variant: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The typed table of one supertype path, or of one variant of it.

    It keeps the keys and links of ``records`` and has the record's fields in
    a struct column ``fields`` (so names can't clash with keys).
    """
    schema = schema or subtype_schema(records, path)
    rows = records.filter(F.col("path") == path)
    if variant is not None:
        rows = rows.filter(F.col("variant") == variant)
    return rows.withColumn("fields", F.from_json("record", schema))


def array_records(nodes: DataFrame, with_record: bool = False, typed: bool = False) -> DataFrame:
    """The records in ``content`` of gamedata and in ``metadata`` of all nodes."""
    content = F.when(F.col("corpus") == "gamedata", F.col("content"))
    return flatten_records(nodes.withColumnRenamed("id", "node_id") if "node_id" not in nodes.columns else nodes.drop("node_id").withColumnRenamed("id", "node_id"), ["slug", "node_id"], {"content": content, "metadata": F.col("metadata")}, with_record, typed)


def typed_records(nodes: DataFrame) -> DataFrame:
    """(slug, node_id, field_name, child_ptr, parent_ptr, path, variant, fields): the typed row of each record of every path and variant.

    (field_name, path) tells the supertype's table, variant the subtype's; a
    variant's fields have one type each, integers beyond 64 bits aside.
    parent_ptr leads to the parent's row of the same field. Equal nodes count
    once.
    """
    return array_records(nodes.select("slug", "id", "corpus", "content", "metadata").dropDuplicates(), typed=True)


def found_records(nodes: DataFrame) -> DataFrame:
    """Distinct (slug, node_id, field_name, child_ptr, parent_ptr).

    One shuffle, of the links alone; copies of a node collapse before it.
    """
    return array_records(nodes).select("slug", "node_id", "field_name", "child_ptr", "parent_ptr").distinct()


def leaves_of(root: dict) -> list[tuple[str, str]]:
    """(dotted path, JSON text) of each leaf; empty objects and arrays are leaves."""
    out, stack = [], [("", root)]
    while stack:
        path, value = stack.pop()
        if type(value) is dict and value:
            stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(value.items()))
        elif type(value) is list and value:
            stack.extend((f"{path}.{n}" if path else str(n), v) for n, v in reversed(list(enumerate(value))))
        elif path:
            out.append((path, str(value) if type(value) is _Int else _clean(json.dumps(value, ensure_ascii=False))))
    return out
