import json

import pytest
from pyspark.sql import functions as F

from lodestrata import cli
from lodestrata.engine import Engine, call, clamp
from lodestrata.operators import catalog, diffing, embedding, store
from lodestrata.operators.incremental import IncrementalRun
from lodestrata.streaming import ingest

META = "patchline string, branch string, slug string, version_date string, short_hash string, build_number int, indexed_at timestamp_ntz"
NODES = "slug string, id string, node_type string, display_name string, file_path string, line_start int, line_end int, content string, embedding_text string, chunk_index int, owning_file string, metadata string, corpus string, data_type string, published_date string"
EDGES = "slug string, id bigint, source_id string, target_id string, edge_type string, owning_file_id string, target_resolved int, metadata string"
V1, V2, P = "release_b100_2026-06-20-aaa", "release_b110_2026-07-23-bbb", "pre-release_b120_2026-07-01-ccc"


def node(slug, id_, corpus, name, content, text=None, kind="x", data_type=None, metadata=None, date=None, line=1):
    return (slug, id_, kind, name, f"{name}.txt", line, line + 9, content, text, 0, f"{name}.txt", metadata, corpus, data_type, date)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("data"))
    meta = [("release", "m", V1, "2026-06-20", "aaa", 100, None), ("release", "m", V2, "2026-07-23", "bbb", 110, None), ("pre-release", "n", P, "2026-07-01", "ccc", 120, None)]
    spark.createDataFrame(meta, META).coalesce(1).write.parquet(f"{d}/version_meta.parquet")
    public, private = '{"visibility": "public", "thin": false}', '{"visibility": "private"}'
    nodes = []
    for slug in (V1, V2, P):
        nodes += [
            node(slug, "class:core.Store", "code", "Store", "class Store {}", None, "JavaClass"),
            node(slug, "core.Store#openInventory", "code", "Store#openInventory", "void openInventory() { slots(); }", "open inventory slots", "JavaMethod", metadata=public),
            node(slug, "core.Store#close", "code", "Store#close", "void close() {}\n// needle", "close the store", "JavaMethod", metadata=private, line=20),
            node(slug, "net.Socket#openInventory", "code", "Socket#openInventory", "void openInventory() {}", "socket inventory", "JavaMethod"),
            node(slug, "gamedata:item:torch", "gamedata", "Torch", '{"Id": "Torch", "Light": 1}', "Item: Torch", "GameData", "item"),
            node(slug, "gamedata:recipe:torch", "gamedata", "TorchRecipe", '{"Id": "TorchRecipe"}', "Recipe: Torch craft", "GameData", "recipe"),
            node(slug, "ui:Craft.ui", "client", "Craft", "Craft panel torch", "UI: Craft", "ui", "ui"),
            node(slug, "blog:news#00", "docs", "News", "torch news", "Docs: News torch", "DocsPage", "changelog", date="2026-05-05"),
            node(slug, "modding:guide#00", "docs", "Guide", "how to make a torch", "Docs: Guide torch", "DocsPage", "guide", date="2024-01-01"),
        ]
    nodes[-1] = node(P, "modding:guide#00", "docs", "Guide two", "how to make a torch", "Docs", "DocsPage", "guide", date="2026-02-02")
    nodes[-5] = node(P, "gamedata:item:torch", "gamedata", "Torch", '{"Id": "Torch", "Light": 2, "New": [1]}', "Item: Torch", "GameData", "item")
    nodes.append(node(P, "gamedata:item:sword", "gamedata", "IronSword", "{}", "Item: IronSword", "GameData", "item"))
    spark.createDataFrame(nodes + nodes[:3], NODES).write.parquet(f"{d}/nodes.parquet")
    edges = [(s, k * 10 + n, a, b, t, "f", 1, None) for k, s in enumerate((V1, V2, P)) for n, (a, b, t) in enumerate([("gamedata:recipe:torch", "gamedata:item:torch", "PRODUCES_ITEM"), ("gamedata:item:torch", "class:core.Store", "IMPLEMENTED_BY"), ("ui:Craft.ui", "gamedata:item:torch", "UI_BINDS_TO"), ("core.Store#close", "core.Store#openInventory", "CALLS"), ("gamedata:item:sword", "gamedata:item:torch", "REQUIRES_ITEM")])]
    spark.createDataFrame(edges, EDGES).write.parquet(f"{d}/edges.parquet")
    return d


@pytest.fixture(scope="module")
def engine(spark, root):
    return Engine(spark, root)


def ids(df):
    return [r.node_id for r in df.orderBy("rank").collect()]


def test_versions_resolve(spark, root, engine):
    assert engine.slug == V2 and Engine(spark, root, "pre-release").slug == P
    for ref in ("release@b100", "release@100", "release@aaa", V1, "b100_2026-06-20-aaa"):
        assert Engine(spark, root, ref).slug == V1
    with pytest.raises(LookupError):
        Engine(spark, root, "release@nope")
    assert [r.slug for r in engine.versions().collect()] == [V2, P, V1]
    assert [r.slug for r in catalog.prune_candidates(engine.meta, 1).collect()] == [V1] and catalog.prune_candidates(engine.meta, 0).collect() == []
    assert store.version_slug("release", 100, "2026-06-20", "aaa") == V1


def test_code_search_and_its_filters(engine):
    got = ids(engine.search_code("openInventory", 5))
    assert set(got[:2]) == {"core.Store#openInventory", "net.Socket#openInventory"} and len(got) == 3
    assert ids(engine.search_code("openInventory", class_filter="Store", class_exact=True))[0] == "core.Store#openInventory"
    assert ids(engine.search_code("openInventory", path_prefix="Socket#open")) == ["net.Socket#openInventory"]
    assert "core.Store#close" not in ids(engine.search_code("store close", visibility="public"))
    assert ids(engine.search_code("  ")) == []
    hits = engine.search_code("openInventory", 2).orderBy("rank").collect()
    assert hits[0].score > hits[1].score  # the second is a near duplicate by name


def test_corpus_search_types_penalty_recency_source(engine):
    assert ids(engine.search_corpus("how to craft torch", "gamedata"))[0] in ("gamedata:recipe:torch", "gamedata:item:torch")
    assert ids(engine.search_corpus("torch", "gamedata", types=["recipe"])) == ["gamedata:recipe:torch"]
    assert ids(engine.search_corpus("torch", "docs", newest=True)) == ["blog:news#00", "modding:guide#00"]
    assert ids(engine.search_corpus("torch", "docs", source="modding")) == ["modding:guide#00"]
    assert ids(engine.search_corpus("torch", "gamedata", contains="craft")) == ["gamedata:recipe:torch"]
    assert len(ids(engine.search("torch", 4))) == 4
    assert "class:core.Store" in ids(engine.with_settings(score_floor=0.0, min_seed_score=0.0, min_result_score=0.0).search_expanded("torch", ["gamedata", "code"]))
    assert set(engine.topic_context("torch")) == {"docs", "code", "gamedata"}


def test_reranker(spark, root):
    e = Engine(spark, root, reranker=lambda q, texts: [(len(texts) - 1, 0.9)])
    plain = ids(Engine(spark, root).search_corpus("torch", "docs"))
    rows = e.search_corpus("torch", "docs").orderBy("rank").collect()
    assert {r.node_id for r in rows} == set(plain) and [r.relevance for r in rows].count(0.9) == 1


def test_tools(engine):
    assert "gamedata:recipe:torch" in call(engine, "recipe", {"node": "gamedata:item:torch"})["content"]
    assert "class:core.Store" in call(engine, "implementing_code", {"node": "gamedata:item:torch"})["content"]
    assert "core.Store#close" in call(engine, "usages", {"node": "core.Store#openInventory"})["content"]
    assert "needle" in call(engine, "search_text", {"pattern": "needle"})["content"]
    assert call(engine, "search_docs", {"query": "torch", "verbosity": "ids"})["content"].startswith("results[2]{node_id,display_name,score,corpus}")
    for tool, arguments in (("stats", {}), ("list_versions", {}), ("node", {"node": "Torch"}), ("related", {"node": "gamedata:item:torch", "depth": 2}), ("file_path", {"query": "store"}), ("class", {"name": "Store"}), ("source", {"node": "core.Store#close", "start": 21, "end": 21}), ("drops", {"node": "Torch"}), ("shops", {"node": "Torch"}), ("group_members", {"node": "Torch"}), ("gamedata_for_code", {"node": "class:core.Store"}), ("search", {"query": "torch"}), ("search_gamedata", {"query": "torch"}), ("search_client_code", {"query": "craft"}), ("topic_context", {"topic": "torch"}), ("diff_versions", {})):
        assert "content" in call(engine, tool, arguments), tool
    assert "needle" in call(engine, "source", {"node": "core.Store#close", "start": 21, "end": 21})["content"] and "void" not in call(engine, "source", {"node": "core.Store#close", "start": 21, "end": 21})["content"]
    assert "error" in call(engine, "search", {}) and "error" in call(engine, "nothing", {}) and "error" in call(engine, "source", {"path": "../etc"})
    assert clamp(None, 5, 20) == 5 and clamp(99, 5, 20) == 20 and clamp(0, 5, 20) == 1 and clamp(3.0, 5, 20) == 3


def test_routes(engine):
    assert engine.route("what extends Base") == ("GRAPH", "EXTENDS", "Base") and engine.route("how to craft torch") == ("HYBRID", "REQUIRES_ITEM", "torch")
    assert engine.route("find class Store") == ("HYBRID", None, "Store") and engine.route("the open door") == ("VECTOR", None, None) and engine.route("Unknown thing")[0] == "VECTOR"


def test_diff(engine):
    d = engine.diff("release", "pre-release")
    got = {r.id: (r.change, r.significance, r.detail) for r in d["entries"].collect()}
    assert got == {"gamedata:item:sword": ("ADDED", "HIGH", None), "gamedata:item:torch": ("CHANGED", "MEDIUM", "fields"), "modding:guide#00": ("CHANGED", "LOW", "title,date")}
    assert [r.id for r in d["entries"].orderBy("rank").collect()][0] == "gamedata:item:sword"
    assert {r.corpus: (r.added, r.changed) for r in d["summary"].collect()} == {"gamedata": (1, 1), "docs": (0, 1)}
    assert {r.other_id for r in d["references"].filter("id = 'gamedata:item:sword'").collect()} == {"gamedata:item:torch"}
    assert [r.id for r in engine.diff("release", "pre-release", corpus="docs")["entries"].collect()] == ["modding:guide#00"]
    a, b = (diffing.node_states(engine.all_nodes, s) for s in (V2, P))
    fields = diffing.field_changes(*(diffing.flatten_json(x.filter("corpus = 'gamedata'"), ["id"], "content") for x in (a, b)), ["id"])
    assert {(r.path, r.change, r.old_value, r.new_value) for r in fields.collect()} == {("Light", "CHANGED", "1", "2"), ("New.0", "ADDED", None, "1")}
    docs = engine.spark.createDataFrame([(n, t) for n, t in enumerate(["The ironsword is here", "no sword", "IRONSWORD!", "ironsword", "ironsword"])], "doc_id int, text string")
    assert [r.doc_id for r in diffing.patch_notes(diffing.version_diff(a, b), docs).orderBy("rank").collect()] == [0, 2, 3]
    assert [tuple(r) for r in diffing.skipped_corpora(a, b.filter("corpus <> 'client'")).collect()] == [("client", "old")]


def test_snapshots_and_store(spark, engine, tmp_path):
    store.write_snapshot(diffing.node_states(engine.all_nodes, V2), f"{tmp_path}/s")
    snap = store.read_snapshot(spark, f"{tmp_path}/s")
    assert {r.id for r in diffing.version_diff(snap, diffing.node_states(engine.all_nodes, P)).collect()} >= {"gamedata:item:sword", "gamedata:item:torch"}
    nodes = engine.nodes.select("slug", "corpus", "id", "content", "owning_file")
    store.write_nodes(nodes, str(tmp_path))
    delta = nodes.filter("id = 'gamedata:item:torch'").withColumn("content", F.lit("new"))
    gone = nodes.filter("corpus = 'docs' and owning_file = 'News.txt'")
    store.apply_delta(spark, str(tmp_path), delta, gone)
    after = {r.id: r.content for r in spark.read.parquet(f"{tmp_path}/nodes").collect()}
    assert after["gamedata:item:torch"] == "new" and "blog:news#00" not in after and len(after) == 8
    out = store.index_corpora({"a": lambda: 1, "b": lambda: 1 / 0})
    assert out["a"] == 1 and isinstance(out["b"], ZeroDivisionError)
    assert store.needs_rebuild(11, 12, True) and not store.needs_rebuild(None, 12, False)


def test_catalog(spark, rows):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "k string, h string")
    b = spark.createDataFrame([("y", "2"), ("z", None), ("w", "1")], "k string, h string")
    changes = catalog.change_set(a, b, ["k"], "h")
    assert rows(changes) == [("w", "DELETED"), ("x", "ADDED"), ("y", "CHANGED"), ("z", "UNCHANGED")]
    same = catalog.change_set(a, a, ["k"], "h").withColumn("c", F.lit("code"))
    assert rows(catalog.may_skip(same, ["c"])) == [("code", True, 0)]
    assert rows(catalog.may_skip(changes.withColumn("c", F.lit("code")), ["c"])) == [("code", False, 2)]
    assert rows(catalog.upsert(a, b, ["k"])) == [("w", "1"), ("x", "1"), ("y", "2"), ("z", None)]
    ids_ = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "k string, n int")
    assert rows(catalog.numbered_ids(ids_, "k", ["n"])) == [("a", 1), ("a~2", 2), ("a~3", 4), ("b", 3)]
    rules = spark.createDataFrame([("g", "Kw*", False), ("g", "*Chick*", False), ("g", "Kw_M", True), ("h", "Raz", False)], "group_id string, glob string, exclude boolean")
    names = spark.createDataFrame([(n,) for n in ("Kw_A", "Kw_M", "BigChicken", "Raz", "kw_b")], "name string")
    assert rows(catalog.glob_members(rules, names)) == [("g", "BigChicken"), ("g", "Kw_A"), ("h", "Raz")]
    docs = spark.createDataFrame([(1, "blog", "t"), (2, "repo", "t"), (3, "other", "u"), (4, "repo", None)], "doc_id int, source string, text string")
    assert [r.doc_id for r in catalog.source_priority(docs).orderBy("doc_id").collect()] == [2, 3]


def test_embedding(spark, monkeypatch):
    texts = spark.createDataFrame([("a b",), ("a b",), (None,), ("c",)], "t string")
    cache = spark.createDataFrame([], "content_hash string, model_id string, vector array<float>, dimension int")
    made = embedding.embed_missing(texts, cache, "t", embedding.HashingBackend(8))
    assert made.count() == 2 and embedding.embed_missing(texts, made, "t", embedding.HashingBackend(8)).count() == 0
    assert {r.hit for r in catalog.cache_lookup(texts, made, "t", "hashing-8").collect()} == {True}
    assert embedding.ConstantBackend().embed(["x"]) == [[1.0] * 8]
    waits, sent = [], []

    def send(part, purpose):
        sent.append(len(part))
        if len(waits) < 1:
            raise RuntimeError("busy")
        return [[1.0]] * len(part)

    remote = embedding.RemoteBackend("r", 1, send, batch=2, wait=waits.append)
    assert len(remote.embed(["a", "b", "c"])) == 3 and sent == [2, 2, 1] and waits == [1.0]

    class Fatal(Exception):
        fatal = True

    with pytest.raises(Fatal):
        embedding.RemoteBackend("r", 1, lambda p, q: (_ for _ in ()).throw(Fatal()), wait=waits.append).embed(["x"])
    assert embedding.service("cohere", send).batch == 96
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [2.0, 0.0])], "vec_id int, embedding array<double>")
    got = [(r.query_key, r.vec_id, r.rank) for r in embedding.nearest(v, v.filter("vec_id = 1"), 2).orderBy("rank").collect()]
    assert got == [(1, 7, 0), (1, 2, 1)]
    whole = sorted(map(tuple, embedding.nearest(v, v, 2).collect()))
    monkeypatch.setattr(embedding, "BROADCAST_BYTES", 20)
    assert sorted(map(tuple, embedding.nearest(v, v, 2).collect())) == whole


def test_stream_of_deliveries(spark, tmp_path):
    schema = "file_path string, file_hash string, batch_id bigint"
    run, seen = IncrementalRun(spark, f"{tmp_path}/ledger", ["file_path"], "file_hash", "batch_id"), []
    write = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for data in ([("a", "1", 1), ("b", "1", 1)], [("a", "1", 2), ("b", "2", 2), ("c", "1", 2)]):
        write(data)
        ingest.apply_deliveries(ingest.deliveries(spark, f"{tmp_path}/in", schema), run, f"{tmp_path}/cp", lambda df: seen.append(sorted(r.file_path for r in df.collect()))).awaitTermination()
    assert seen == [["a", "b"], ["b", "c"]]


def test_event_windows(spark):
    from datetime import datetime

    events = spark.createDataFrame([(datetime(2031, 1, 1, 0, m), "a", 1.0) for m in (1, 9, 11)], "ts timestamp, event_type string, value double")
    assert sorted(r.n for r in ingest.event_counts(events).collect()) == [1, 2]


def test_cli(tmp_path, root, capsys, monkeypatch):
    conf = str(tmp_path / "c.json")
    assert cli.main(["--config", conf, "init", "--provider", "openai", "--root", root]) == 0
    assert cli.main(["--config", conf, "init"]) == 1
    assert cli.settings(conf, {"LODESTRATA_PROVIDER": "x", "LODESTRATA_DIMENSIONS": "9"}) == cli.DEFAULTS | {"provider": "x", "dimensions": 9, "root": root}
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["index", "--source", "a", "--out", "b", "--slug", "c", "--docs-source", "nope"])
    assert cli.main(["--config", conf, "call", "list_versions"]) == 0 and V2 in capsys.readouterr().out
    assert cli.main(["--config", conf, "call", "search"]) == 1
    golden = tmp_path / "g.jsonl"
    golden.write_text("\n".join(json.dumps(g) for g in ({"tool": "search_code", "query": "openInventory", "expectedIds": ["store#openinventory"]}, {"tool": "search_docs", "query": "torch guide", "expectedIds": ["modding:guide"]})) + "\n\n")
    capsys.readouterr()
    assert cli.main(["--config", conf, "eval", "--golden", str(golden), "--baseline", "0.9", "--sweep", '{"name_weight": [1.0, 10.0]}']) == 0
    assert json.loads(capsys.readouterr().out)["overall"]["recall_at_5"] == 1.0


def test_index_a_tree(spark, tmp_path):
    for path, text in {"java/a/A.java": "package a; class A { void m() {} }", "assets/Server/Weathers/R.json": '{"Id": "R"}', "ui/In/P.ui": "x", "docs/modding/g.md": "## T\n\nbody"}.items():
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(text)
    assert cli.main(["--config", str(tmp_path / "none"), "index", "--source", str(tmp_path / "src"), "--out", str(tmp_path / "out"), "--slug", "s"]) == 0
    got = {(r.corpus, r.id) for r in spark.read.parquet(f"{tmp_path}/out/nodes").collect()}
    assert {("code", "a.A#m"), ("gamedata", "gamedata:Server:Weathers:R"), ("client", "ui:In/P.ui"), ("docs", "modding:g#01-t")} <= got


@pytest.mark.parametrize("block_chars", [1 << 20, 12])
def test_patch_notes_find_substrings_of_texts_and_titles(spark, rows, block_chars):
    names = ["Torch", "Iron Sword", "Ore_", "....", "Elm", None]
    diff = spark.createDataFrame([(n, "HIGH") for n in names] + [("Ledger", "LOW")], "display_name string, significance string")
    texts = ["CopperTorch and torches", "biron swords", None, "more_ and more....", "a ledger by elm", None, "torc h"]
    titles = [None, "x", "All about TORCHES", "t", None, None, "tor"]
    docs = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(zip(texts, titles))], "doc_id int, text string, title string")
    assert rows(diffing.patch_notes(diff, docs, block_chars=block_chars)) == [("....", 3, 1), ("iron sword", 1, 1), ("ore_", 3, 1), ("torch", 0, 1), ("torch", 2, 2)]
    assert rows(diffing.patch_notes(diff.limit(0), docs, block_chars=block_chars)) == rows(diffing.patch_notes(diff, docs.limit(0))) == []
