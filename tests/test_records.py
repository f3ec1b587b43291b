import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import records as R

NODES = "slug string, id string, corpus string, content string, metadata string, child_ptr string"


def brute(text):
    """(child_ptr, parent_ptr) by plain recursion."""
    out = []

    def walk(v, ptr, owner):
        if isinstance(v, dict):
            for k, c in v.items():
                walk(c, ptr + "/" + k.replace("~", "~0").replace("/", "~1"), owner)
        elif isinstance(v, list):
            for n, c in enumerate(v):
                p = f"{ptr}/{n}"
                if isinstance(c, dict):
                    out.append((p, owner))
                    walk(c, p, p)
                else:
                    walk(c, p, owner)

    walk(json.loads(text), "", "")
    return sorted(out)


@pytest.mark.parametrize(
    "text, good",
    [
        ('{"a": 1}', True),
        ('﻿{"a": 1}', True),
        ('{"a": [1, 2,], }', True),
        ('{// note\n"a": /* b */ 1}', True),
        ('{"a": "// no comment, }"}', True),
        (json.dumps('{"a": [{"b": 1}]}'), True),
        (json.dumps('{"a": 1,} // x'), True),
        ('{"a": ' + "9" * 5000 + "}", True),
        ('{"a": 1', False),
        ('{"a": [,]}', False),
        ("{,}", False),
        ('{"a": 1,,}', False),
        ('{"a": NaN}', False),
        ('{"a": 1} x', False),
        ("{'a': 1}", False),
        ("[1]", False),
        ('"text"', False),
        ('{"a": 1 /* open', False),
        ("", False),
        (None, False),
        ("{" * 100_000, False),
    ],
)
def test_parse_object(text, good):
    assert (R.parse_object(text) is not None) == good


def test_pointers_of_all_depths_and_nested_arrays(spark, rows):
    text = json.dumps({"a": [{"b": [[{"c": [1, {"d~/": [{}]}]}]]}, 5, None], "x": {"y": [{}]}, "e": []})
    nodes = spark.createDataFrame([("s", "n", "gamedata", text, None, "clash")], NODES)
    found = [(r.child_ptr, r.parent_ptr) for r in R.found_records(nodes).collect()]
    assert sorted(found) == brute(text)
    assert ("/a/0/b/0/0/c/1/d~0~1/0", "/a/0/b/0/0/c/1") in found


def test_nulls_copies_other_corpora_and_empty_tables(spark, rows):
    meta = '{"t": [{"k": 1}]}'
    data = [("s", "n", "gamedata", None, meta, None)] * 3 + [("s", "m", "code", '{"a": [{}]}', None, None), (None, None, "docs", None, meta, None), ("s", "b", "gamedata", '{"a": [{', "", None)]
    nodes = spark.createDataFrame(data, NODES)
    assert rows(R.found_records(nodes)) == sorted([("s", "n", "metadata", "/t/0", ""), (None, None, "metadata", "/t/0", "")], key=str)
    assert rows(R.found_records(nodes.limit(0))) == []


def test_variants_ignore_order_and_repetition_but_not_shape(spark):
    def variant(text):
        return R.records_of(R.parse_object(text), R.ShapeAutomaton())[0][3]

    assert variant('{"a": [{"x": 1, "y": ["a"]}]}') == variant('{"a": [{"y": ["b", "c"], "x": 2}]}')
    assert variant('{"a": [{"x": 1}]}') != variant('{"a": [{"x": "1"}]}')
    assert variant('{"a": [{"x": 1}]}') != variant('{"a": [{"x": 1, "y": 1}]}')


def test_subtype_tables_are_typed_and_keep_links(spark):
    text = '{"items": [{"id": "a", "n": 1, "w": 1, "sub": [{"z": true}]}, {"id": "b", "w": 1.5}]}'
    nodes = spark.createDataFrame([("s", "n", "gamedata", text, None, None)], NODES)
    records = R.array_records(nodes, with_record=True)
    table = R.subtype_table(records, "/items/*")
    assert dict(table.select("fields.*").dtypes) == {"id": "string", "n": "bigint", "w": "double"}
    assert [(r.child_ptr, r.id, r.n, r.w) for r in table.select("child_ptr", "fields.*").orderBy("child_ptr").collect()] == [("/items/0", "a", 1, 1.0), ("/items/1", "b", None, 1.5)]
    catalog = {(r.path, r.name): (r.type, r.n_present, r.n_records) for r in R.subtype_catalog(records).collect()}
    assert catalog["/items/*", "w"] == ("double", 2, 2) and catalog["/items/*", "n"] == ("bigint", 1, 2) and catalog["/items/*/sub/*", "z"] == ("boolean", 1, 1)
    child = R.subtype_table(records, "/items/*/sub/*").select("parent_ptr", "fields.z").collect()
    assert [tuple(r) for r in child] == [("/items/0", True)]
    assert R.variant_catalog(records).agg(F.sum("n_records")).collect()[0][0] == 3


def test_clashing_keys_are_refused(spark):
    nodes = spark.createDataFrame([("s", "n", "gamedata", "{}", None, "x")], NODES)
    with pytest.raises(ValueError):
        R.flatten_records(nodes, ["child_ptr"], {"content": F.col("content")})


def test_lone_surrogates_and_deep_nesting(spark, rows):
    deep = '{"a": ' + '[{"a": ' * 150 + "1" + "}]" * 150 + "}"
    nodes = spark.createDataFrame([("s", "u", "gamedata", '{"\\ud800": [{"x": "\\udfff"}]}', None, None), ("s", "d", "gamedata", deep, None, None)], NODES)
    found = R.array_records(nodes, with_record=True).collect()
    assert sum(r.node_id == "d" for r in found) == 150
    assert sum(r.node_id == "u" for r in found) == 1


def test_types_come_from_json_tokens(spark):
    text = '{"items": [{"a": "12", "b": "true", "c": 12, "d": 12345678901234567890}, {"a": "7", "b": "no", "c": 9007199254740993, "d": 1}]}'
    nodes = spark.createDataFrame([("s", "n", "gamedata", text, None, None)], NODES)
    records = R.array_records(nodes, with_record=True)
    table = R.subtype_table(records, "/items/*")
    assert dict(table.select("fields.*").dtypes) == {"a": "string", "b": "string", "c": "bigint", "d": "string"}
    assert [tuple(r) for r in table.orderBy("child_ptr").select("fields.*").collect()] == [("12", "true", 12, "12345678901234567890"), ("7", "no", 9007199254740993, "1")]
    assert {r.name: r.type for r in R.subtype_catalog(records).collect()} == {"a": "string", "b": "string", "c": "bigint", "d": "string"}


def test_typed_rows_of_all_paths_and_variants(spark, tmp_path):
    from lodestrata.plans.training import QUERIES

    text = '{"items": [{"id": "1", "n": 1, "w": 1.5, "ok": true, "no": null, "l": [1, "\\ud800"], "sub": [{"z": 12345678901234567890}, {}]}]}'
    spark.createDataFrame([("s", "n", "gamedata", text, '{"t": [{"k": "true"}]}', None)] * 2, NODES).write.parquet(f"{tmp_path}/nodes.parquet")
    df = QUERIES["p2_typed"](spark, str(tmp_path))
    assert df.columns == ["slug", "node_id", "field_name", "child_ptr", "parent_ptr", "path", "variant", "fields"]
    found = {(r.field_name, r.child_ptr): r for r in df.collect()}
    assert df.count() == len(found) == 4
    values = {k: {f.name: (f.type, f[2:]) for f in r.fields} for k, r in found.items()}
    none = (None,) * 4
    item = {"id": ("string", (None, None, None, "1")), "n": ("bigint", (1, None, None, None)), "w": ("double", (None, 1.5, None, None)), "ok": ("boolean", (None, None, True, None)), "no": ("null", none), "l": ("json", (None, None, None, '[1, "\ufffd"]'))}
    assert values["content", "/items/0"] == item
    assert values["content", "/items/0/sub/0"] == {"z": ("integer", (None, None, None, "12345678901234567890"))} and values["content", "/items/0/sub/1"] == {}
    assert values["metadata", "/t/0"] == {"k": ("string", (None, None, None, "true"))}
    assert found["content", "/items/0/sub/0"].parent_ptr == "/items/0" and found["content", "/items/0/sub/0"].path == "/items/*/sub/*"
    assert found["content", "/items/0/sub/0"].variant != found["content", "/items/0/sub/1"].variant
