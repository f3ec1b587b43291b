import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.encoding import encode, quoted, rows_of, to_compact
from lodestrata.sources import docs, files, java, ui
from lodestrata.sources import json_records as J

JAVA = '''package com.x;
import java.util.List;
/** doc { */
@Deprecated
public class Sub<T> extends Base implements Iface, Comparable<Map<String, T>> {
    private final int n = 3;
    private static final List<String> L = List.of("a{", "b");
    static class Inner { void deep() { } }
    /** Says "hi". */
    @Override
    public void run(List<String> names, final int... n) {
        if (names instanceof ArrayList x) { Helper.call(1); this.build(); local(); }
    }
    public void run() { run(null); }
    String build() { return Helper.make("}"); }
    abstract int none(@Nullable String s);
    Sub(int a) { super(a); }
    enum Kind { A, B; int v() { return 1; } }
}
record Point(int x, int y) { int sum() { return x + y; } }
'''  # noqa: E501


def test_java_parts():
    p = java.parse(JAVA)
    assert {t["full"]: t["supers"] for t in p["types"]} == {"com.x.Sub": {"EXTENDS": ["Base"], "IMPLEMENTS": ["Iface", "Comparable"]}, "com.x.Sub.Inner": {}, "com.x.Sub.Kind": {}, "com.x.Point": {}}
    m = {(x["owner"], x["name"], len(x["types"])): x for x in p["methods"]}
    assert set(m) == {("com.x.Sub", "run", 2), ("com.x.Sub", "run", 0), ("com.x.Sub", "build", 0), ("com.x.Sub", "none", 1), ("com.x.Sub", "Sub", 1), ("com.x.Sub.Inner", "deep", 0), ("com.x.Sub.Kind", "v", 0), ("com.x.Point", "sum", 0)}
    run = m["com.x.Sub", "run", 2]
    assert run["types"] == ["List", "int[]"] and run["visibility"] == "public" and run["annotations"] == ["Override"] and run["line_start"] == 9 and ("Helper", "call") in run["calls"] and run["instanceof"] == ["ArrayList"]
    assert m["com.x.Sub", "build", 0]["thin"] and not run["thin"]
    assert java.parse("class {{{ broken (") == {"package": "", "types": [], "methods": []}
    assert java.split_commas("Map<A, B> m, int[] x") == ["Map<A, B> m", "int[] x"]


def test_java_nodes_and_edges(spark, tmp_path):
    (tmp_path / "com").mkdir()
    (tmp_path / "com/Sub.java").write_text(JAVA)
    (tmp_path / "com/Base.java").write_text("package com.x; class Base { void build() {} } class Helper { static void call(int a) {} }")
    nodes = java.java_nodes(files.read_tree(spark, [str(tmp_path)], "*.java")).persist()
    ids = {r.id for r in nodes.collect()}
    assert {"pkg:com.x", "class:com.x.Sub", "com.x.Sub#run", "com.x.Sub#run~2", "class:com.x.Helper"} <= ids
    edges = {(r.source_id, r.target_id, r.edge_type, r.target_resolved) for r in java.java_edges(nodes).collect()}
    assert {("class:com.x.Sub", "class:com.x.Base", "EXTENDS", 1), ("class:com.x.Sub", "class:Iface", "IMPLEMENTS", 0), ("com.x.Sub#run", "com.x.Helper#call", "CALLS", 1), ("com.x.Sub#run", "class:com.x.Sub", "DECLARED_IN", 1), ("com.x.Sub#build", "class:com.x.Helper", "CALLS", 1)} <= edges


def test_game_data(spark, tmp_path):
    def put(path, value):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(value if isinstance(value, str) else json.dumps(value))

    put("Server/Item/Items/Foo.json", {"Id": "Foo", "Recipe": {"Input": [{"ItemId": "bar"}, {"ResourceTypeId": "Wood"}], "BenchRequirement": [{"Id": "bench"}]}, "Tags": ["hot"]})
    put("Server/Item/Items/Bar.json", '{"Id": "Bar", /* note */ "Weight": 2,}')
    put("Server/Item/Block/Bar.json", {"Id": "Bar"})
    put("Server/Audio/x/Blip.json", {"Layers": [{"Files": ["Sounds/TEST/Blip.ogg"]}], "MaxDistance": 45})
    put("Server/Brandnew/Odd.json", {"Id": "Odd"})
    put("Server/Drops/Bad.json", "{ broken")
    put("other/None.json", {"Id": "None"})
    put("Server/BarterShops/S.json", {"TradeSlots": [{"Trade": {"Output": [{"ItemId": "Foo"}]}}]})
    nodes = J.game_nodes(files.read_tree(spark, [str(tmp_path)], "*.json")).persist()
    got = {r.id: r for r in nodes.collect()}
    assert {k: r.data_type for k, r in got.items()} == {"gamedata:Server:Item:Items:Foo": "item", "gamedata:Server:Item:Items:Bar": "item", "gamedata:Server:Item:Block:Bar": "block", "gamedata:Server:Audio:x:Blip": "audio", "gamedata:Server:Brandnew:Odd": "misc", "gamedata:Server:Drops:Bad": "drop", "gamedata:Server:BarterShops:S": "shop"}
    assert got["gamedata:Server:Drops:Bad"].error and got["gamedata:Server:Audio:x:Blip"].embedding_text.startswith("Audio: Blip") and "Sounds/TEST/Blip.ogg" in got["gamedata:Server:Audio:x:Blip"].embedding_text and "MaxDistance: 45" in got["gamedata:Server:Audio:x:Blip"].embedding_text
    assert "Keywords: hot" in got["gamedata:Server:Item:Items:Foo"].embedding_text and got["gamedata:Server:Item:Items:Foo"].related == ["bar", "Wood"]
    edges = {(r.source_id.rsplit(":", 1)[1], r.target_id, r.edge_type, r.target_resolved, r.metadata) for r in J.game_edges(nodes).collect()}
    multi = '{"multi_match": true}'
    assert {("Foo", "gamedata:Server:Item:Items:Bar", "REQUIRES_ITEM", 1, multi), ("Foo", "gamedata:Server:Item:Block:Bar", "REQUIRES_ITEM", 1, multi), ("Foo", "virtual:resource:Wood", "REQUIRES_ITEM", 0, None), ("Foo", "virtual:bench:bench", "REQUIRES_BENCH", 0, None), ("S", "gamedata:Server:Item:Items:Foo", "OFFERED_IN_SHOP", 1, None)} == edges


def test_archives_schemas_manifests_languages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Server/Weathers/Rain.json", '{"Id": "Rain"}')
        z.writestr("readme.txt", "x")
    assert [(r.id, r.data_type) for r in files.classified(files.read_archives(spark, str(tmp_path))).collect()] == [("gamedata:Server:Weathers:Rain", "weather")]
    assert [n["display_name"] for n in J.parse_schema("a", '{"definitions": {"Color": {}, "Size": {}}}')] == ["Color", "Size"]
    assert J.parse_schema("a", '{"title": "Item"}')[0]["id"] == "gamedata:schema:Item" and J.parse_schema("a", "[]") == []
    assert J.parse_manifest("m", '{"Name": "A"}')["id"] == "gamedata:manifest:A" and J.parse_manifest("m", '{"Name": " "}') is None
    assert J.parse_language("# header\nx.msg = a={b}, c=d\nwrap = line1 \\\n    line2\nbad") == {"x.msg": "a={b}, c=d", "wrap": "line1 line2"}
    assert J.language_prefix("Common/Languages/en-US/avatarCustomization/faces.lang") == "avatarCustomization.faces"
    assert set(J.language_groups([f"a.{n}" for n in range(40)] + [f"b.{n}" for n in range(40)])) == {"a", "b"} and set(J.language_groups(["a.1"])) == {""}
    assert J.block_palette({"Blocks": [{"Name": "Stone", "x": 1, "y": 2, "z": 0}, {"Name": "Stone", "x": 5, "y": 2, "z": 0}, {"Name": "Wood"}]}) == {"palette": [("Stone", 2), ("Wood", 1)], "box": {"x": (1, 5), "y": (2, 2), "z": (0, 0)}, "n": 3}
    assert J.edges_of("plugin_manifest", {"Dependencies": {"g:B": "1"}, "OptionalDependencies": {"C": "1"}}) == [("DEPENDS_ON", "gamedata:manifest:B", {}), ("DEPENDS_ON", "gamedata:manifest:C", {"optional": True})]


def test_docs(spark):
    text = "---\ntitle: Page\ndate: 2026-01-09\n---\nintro\n\n## Installation\n\nDo it.\n\n```\n## no heading\n```\n\n### Steps\n\nUse `Foo.bar()` and BigThing.\n"
    df = spark.createDataFrame([("a/b.md", text), ("news/2025/3/14/c.md", "only text")], "path string, content string")
    nodes = {r.id: r for r in docs.docs_nodes(df, "modding").collect()}
    assert set(nodes) == {"modding:a/b#00-page", "modding:a/b#01-installation", "modding:a/b#02-steps", "modding:news/2025/3/14/c#00-c"}
    steps = nodes["modding:a/b#02-steps"]
    assert "Parent: Installation" in steps.embedding_text and "Parent" not in steps.content and steps.published_date == "2026-01-09"
    assert "## no heading" in nodes["modding:a/b#01-installation"].content and nodes["modding:news/2025/3/14/c#00-c"].published_date == "2025-03-14"
    targets = spark.createDataFrame([("class:x.BigThing", "BigThing"), ("y", "bigthing")], "id string, display_name string")
    assert [(r.source_id, r.target_id) for r in docs.docs_edges(docs.docs_nodes(df, "modding"), targets).collect()] == [("modding:a/b#02-steps", "class:x.BigThing")]
    page = '<script>x</script><p>intro</p><h2>One</h2><p>a &amp; b</p><h3>Two</h3>text<h2>Cookie</h2>we use cookies'
    assert docs.html_sections(page) == [("Overview", "intro"), ("One", "a & b"), ("Two", "text")]
    urls = spark.createDataFrame([('<a href="/news/2025/1/x">1</a><a href="https://h.com/news/2025/1/x">2</a><a href="/about">',)], "p string").select(docs.post_urls(F.col("p"))).first()[0]
    assert urls == ["/news/2025/1/x"]


def test_ui(spark):
    df = spark.createDataFrame([("InGame/ShopPanel.ui", 'Icon { path: "Icons/Coin.png" } id: "Torch"  GoldCoin'), ("InGame/theme/x.ui", "x"), ("InGame/blank.ui", " \n"), ("a/b.txt", "x")], "path string, content string")
    nodes = ui.ui_nodes(df)
    assert [(r.id, r.category, r.display_name) for r in nodes.collect()] == [("ui:InGame/ShopPanel.ui", "InGame", "ShopPanel")]
    targets = spark.createDataFrame([("g:coin", "coin"), ("g:torch", "Torch"), ("g:gc", "GoldCoin"), ("g:shop", "Shop")], "id string, display_name string")
    assert {(r.target_id, r.confidence) for r in ui.ui_edges(nodes, targets).collect()} == {("g:coin", 0.8), ("g:torch", 0.6), ("g:gc", 0.5), ("g:shop", 0.4)}


def test_encoding():
    value = {"results": [{"a": "x", "b": 0.91}, {"a": "05", "b": 42}], "none": [], "list": ["true", "->", True], "in": {"k": None}}
    assert to_compact(value) == 'results[2]{a,b}:\n  x,0.91\n  "05",42\nnone: []\nlist[3]: "true","->",true\nin:\n  k: null'
    assert [quoted(x) for x in ("", " a", "a,b", "-x", "1e5", "ok")] == ['""', '" a"', '"a,b"', '"-x"', '"1e5"', "ok"]
    assert encode([1, 2]) == "[1, 2]" and encode({"r": [{"a": 1}, {"b": 2}]}).startswith("{")
    assert rows_of([], "ids") == "results: []" and "results[1]{node_id,display_name,score,corpus}:" in rows_of([{"node_id": "n"}], "ids")
    with pytest.raises(ValueError):
        rows_of([], "all")


def test_classes_and_translations_of_records(spark, rows):
    records = spark.createDataFrame([("g:a", "item", "items.a.name"), ("g:a", "item", "items.a.name"), ("g:b", "npc", "nope"), ("g:c", None, None)], "id string, data_type string, name_key string")
    classes = spark.createDataFrame([("class:x.Item", "Item"), ("class:y.Item", "Item"), ("class:x.Other", "Other")], "id string, display_name string")
    mapping = spark.createDataFrame([("item", "Item"), ("item", "Missing"), ("npc", "Absent")], "data_type string, class_name string")
    assert rows(J.implemented_by(records, classes, mapping)) == [("g:a", "class:x.Item", "IMPLEMENTED_BY"), ("g:a", "class:y.Item", "IMPLEMENTED_BY")]
    langs = spark.createDataFrame([("Common/Languages/en-US/items.lang", "a.name = Axe\na.name2=B"), ("Common/Languages/en-US/fallback.lang", "x = y"), ("z/Languages/en-US/items.lang", "a.name = Later"), ("a.json", "a = b")], "path string, content string")
    words = J.translations(langs)
    assert rows(words) == [("items.a.name", "Axe"), ("items.a.name2", "B")]
    assert {(r.id, r.shown) for r in J.translated(records, words, "name_key", "shown").collect()} == {("g:a", "Axe"), ("g:b", None), ("g:c", None)}


def test_text_of_wide_records_is_whole():
    record = {f"F{n}": n for n in range(60)} | {"Inner": {f"G{n}": n for n in range(60)}, "Last": "end"}
    text = J.text_of(record, "Item", "Torch", "Server/Torch.json")
    assert text.splitlines() == ["Item: Torch", *(f"F{n}: {n}" for n in range(60)), *(f"Inner.G{n}: {n}" for n in range(60)), "Last: end", "File: Server/Torch.json"]
