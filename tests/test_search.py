import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import evaluation, lexical, ranking

NODES = "slug string, id string, corpus string, display_name string, content string, line_start int"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).collect()[0][0]


@pytest.mark.parametrize("text, n, want", [("line1\nline2\nline3", 9, "line1\n…"), ("abcdefghij", 5, "abcde\n…"), ("abc", 3, "abc")])
def test_truncate(spark, text, n, want):
    assert one(spark, X.truncate(F.col("t"), n), t=text) == want


def test_window_centres_on_the_hit(spark):
    text = "a" * 200 + " NEEDLE " + "b" * 200
    got = one(spark, X.window(F.col("t"), F.lit("needle"), 100), t=text)
    assert "NEEDLE" in got and got.startswith("…") and got.endswith("…") and len(got) == 102
    assert "doSwapItems" in one(spark, X.window(F.col("t"), F.lit("swapItems"), 100), t="x" * 300 + " doSwapItems " + "y" * 300)


@pytest.mark.parametrize("text, words", [("registerPlayerEvent", "register player event"), ("max_health_points", "max health points"), ("inventory-slot-id", "inventory slot id"), ("HTTPServer", "http server"), ("plain words", None)])
def test_split_identifiers(spark, text, words):
    assert one(spark, X.split_identifiers(F.col("t")), t=text) == (f"{text} {words}" if words else text)


def test_small_functions(spark):
    assert one(spark, X.match_expression(F.col("t")), t='"player" * health: id') == '"player" OR "health" OR "id"'
    assert one(spark, X.match_expression(F.col("t")), t="***") is None
    assert one(spark, X.html_text(F.col("t")), t="<style>x</style><script>y</script><p>Hello&nbsp;world</p>") == "Hello world"
    assert one(spark, X.published_date(F.col("p"), F.col("t")), p="news/2025/3/14/x.md", t="") == "2025-03-14"
    assert one(spark, X.published_date(F.col("p"), F.col("t")), p="news/2024/11/x.md", t="") == "2024-11-01"
    assert one(spark, X.published_date(F.col("p"), F.col("t")), p="x", t="---\ndate: 2026-01-09\n---\n") == "2026-01-09"
    assert one(spark, X.published_date(F.col("p"), F.col("t")), p="x", t="none") is None
    assert one(spark, X.signature(F.col("t")), t="/** doc\n * more\n */\n@Override\npublic void run() {") == "public void run() {"
    assert one(spark, X.source_path(F.col("t")), t="/root/cache/staged/v1/com/A.java") == "com/A.java"
    assert one(spark, X.intents(F.col("t")), t="craft seeds from npc") == "recipe,item,npc,npc_group,farming"
    assert one(spark, X.slug(F.col("t"), fallback="section"), t="???") == "section"
    assert one(spark, F.rlike("n", X.glob_pattern(F.col("g"))), n="Bear_1", g="Bear*") and not one(spark, F.rlike("n", X.glob_pattern(F.col("g"))), n="xBear_1", g="Bear*")
    assert one(spark, X.strip_mdx(F.col("t")), t="---\na: b\n---\nimport X from 'y'\n# T\n<Tabs x={1}>in</Tabs>\n\n\n\nend") == "# T\nin\n\nend"
    facets = X.metadata_facets(F.col("t"))
    assert one(spark, facets["annotations"], t='{"visibility": "public", "annotations": [{"name": "A"}, {"name": "B"}, {"name": "A"}]}') == "A,B"


def test_path_and_class_filters(spark):
    assert one(spark, X.class_matches(F.col("t"), "Box"), t="a.b.Box#run") and not one(spark, X.class_matches(F.col("t"), "Box"), t="a.b.BigBox#run")
    assert one(spark, X.path_matches(F.col("t"), "core"), t="server/core/inventory/A.java") and not one(spark, X.path_matches(F.col("t"), "core"), t="server/corex/A.java")


def test_bm25_equals_sqlite(spark):
    rng = random.Random(3)
    words = ["torch", "copper", "guard", "Élan", "gate", "x1", "rope", "the"]
    docs = [(f"n{i}", " ".join(rng.choices(words, k=rng.randint(0, 3))), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, name, body, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", docs)
    nodes = spark.createDataFrame([("v", i, "docs", n, b, 0) for i, n, b in docs] * 2, NODES)
    queries = [("a", "torch copper"), ("b", "the the guard"), ("c", "x1"), ("d", "nothing")]
    got = {(r.query_id, r.node_id): r.score for r in lexical.bm25(lexical.build_index(nodes), spark.createDataFrame(queries, "query_id string, query string")).collect()}
    for q, text in queries:
        match = " OR ".join(f'"{t}"' for t in text.split())
        want = {i: -s for i, s in con.execute("SELECT id, bm25(f, 0, 10, 1) FROM f WHERE f MATCH ?", (match,))}
        mine = {i: s for (k, i), s in got.items() if k == q}
        assert set(mine) == set(want) and all(math.isclose(mine[i], want[i], rel_tol=1e-9, abs_tol=1e-12) for i in want)


def test_index_of_code_and_names_weigh_more(spark):
    nodes = spark.createDataFrame([("v", "a", "docs", "torch", "irrelevant text", 0), ("v", "b", "docs", "irrelevant", "a torch here", 0), ("v", "c", "code", "Foo", "registerPlayerEvent()", 0), ("v", None, "docs", "torch", "torch", 0), ("w", "d", "docs", None, None, 0), *[("v", f"x{n}", "docs", "x", "y", 0) for n in range(5)]], NODES)
    index = lexical.build_index(nodes)
    q = spark.createDataFrame([("t", "torch"), ("p", "player")], "query_id string, query string")
    ranked = [(r.query_id, r.node_id) for r in lexical.bm25(index, q).orderBy("query_id", "rank").collect()]
    assert ranked == [("p", "c"), ("t", "a"), ("t", "b")]
    assert lexical.match_all(index, spark.createDataFrame([("q", "torch here")], "query_id string, query string")).collect()[0].node_id == "b"
    assert lexical.bm25(lexical.build_index(nodes.limit(0)), q).collect() == []


def test_line_search(spark):
    body = "one\nneedleToken a\nthree\nx needletoken\nneedleToken z"
    nodes = spark.createDataFrame([("v", "n", "code", "N", body, 10), ("v", "n", "code", "N", body, 10), ("v", "m", "code", "M", None, 1), ("v", "k", "code", "K", "needleToken\n" * 9, None)], NODES)
    got = sorted((r.node_id, r.line, r.text, r.context) for r in lexical.search_lines(nodes, "needleToken").collect())
    assert [g[:3] for g in got if g[0] == "n"] == [("n", 11, "needleToken a"), ("n", 13, "x needletoken"), ("n", 14, "needleToken z")]
    assert got[-3][3] == "one\nneedleToken a\nthree\nx needletoken" and len([g for g in got if g[0] == "k"]) == 5
    assert lexical.search_lines(nodes, r"^x\s+needle", regex=True).count() == 1


def lists(spark, *ranked):
    return spark.createDataFrame([("q", n, r, i) for n, ids in enumerate(ranked) for r, i in enumerate(ids)], "query_id string, list_no int, rank int, node_id string")


def test_fusion(spark):
    got = {r.node_id: r.score for r in ranking.rrf(lists(spark, "BAC", "BA")).collect()}
    assert got["B"] == 1.0 and got["B"] > got["A"] > got["C"] > 0
    lifted = ranking.rrf(lists(spark, [f"v{n}" for n in range(9)] + ["Exact"], ["Exact"])).orderBy(F.desc("score")).first()
    assert lifted.node_id == "Exact"
    assert abs(ranking.rrf(lists(spark, "AA"), normalised=False).first().score - (1 / 61 + 1 / 62)) < 1e-12


def test_merge_keeps_the_best_score_and_any_provenance(spark):
    rows = spark.createDataFrame([("q", 0, "X", 0.9, None, None), ("q", 1, "Y", 0.8, None, None), ("q", 2, "X", 0.4, "Torch", "IMPLEMENTED_BY"), ("q", 3, "X", 0.9, "Other", None)], "query_id string, pos int, node_id string, score double, bridged_from string, bridge_type string")
    got = {r.node_id: (r.score, r.pos, r.bridged_from, r.bridge_type) for r in ranking.merge_duplicates(rows).collect()}
    assert got == {"X": (0.9, 0, "Other", "IMPLEMENTED_BY"), "Y": (0.8, 1, None, None)}


def results(spark, data):
    return spark.createDataFrame([("q", i, n, s, t, sc) for i, n, s, t, sc in data], "query_id string, node_id string, display_name string, snippet string, thin boolean, score double")


def test_diversify(spark):
    got = {r.node_id: r.score for r in ranking.diversify(results(spark, [("A", "A#swapItems", "one two", False, 1.0), ("B", "B#swapItems", "three four", False, 0.95), ("C", "C#other", "five six", None, 0.9)])).collect()}
    assert got == {"A": 1.0, "B": 0.475, "C": 0.9}
    body = "the same body of words"
    got = {r.node_id: r.score for r in ranking.diversify(results(spark, [("A", "A#x", body, False, 1.0), ("B", "B#y", body, False, 0.9), ("P", "page", body, False, 0.8)])).collect()}
    assert got == {"A": 1.0, "B": 0.45, "P": 0.8}
    got = {r.node_id: r.score for r in ranking.diversify(results(spark, [("A", "A#x", "a", True, 1.0), ("B", "B#y", None, False, 0.9)]), near_dup=1.0, delegate=0.5).collect()}
    assert got == {"A": 0.5, "B": 0.9}


def test_rerank_and_its_tail(spark):
    rows = spark.createDataFrame([("q", 0, "A", 0.9), ("q", 1, "B", 0.8), ("q", 2, "C", 0.7)], "query_id string, pos int, node_id string, score double")
    order = lambda *xs: spark.createDataFrame([("q", p, n, v) for n, (p, v) in enumerate(xs)], "query_id string, pos int, place int, relevance double")
    got = [(r.node_id, r.relevance) for r in ranking.rerank(rows, order((2, 0.95), (0, 0.6), (1, 0.3))).orderBy("pos").collect()]
    assert got == [("C", 0.95), ("A", 0.6), ("B", 0.3)]
    got = [(r.node_id, r.relevance) for r in ranking.rerank(rows, order((1, 0.9), (0, 0.7)), limit=2).orderBy("pos").collect()]
    assert got == [("B", 0.9), ("A", 0.7), ("C", None)]


def test_expansion_caps_discounts_and_floors(spark):
    seeds = spark.createDataFrame([("q", "s1", 1.0), ("q", "s2", 0.9), ("q", "s3", 0.6)], "query_id string, node_id string, score double")
    links = spark.createDataFrame([("s1", f"t{n}", "IMPLEMENTED_BY", n) for n in range(5)] + [("s1", "s2", "IMPLEMENTED_BY", 9), ("s2", "t0", "IMPLEMENTED_BY", 10), ("s2", "u", "UI_BINDS_TO", 11), ("s3", "low", "UI_BINDS_TO", 12)], "seed_id string, node_id string, edge_type string, seq int")
    got = {r.node_id: (round(r.score, 6), r.bridged_from) for r in ranking.expand(seeds, links).collect()}
    assert got == {"t0": (0.4, "s1"), "t1": (0.4, "s1"), "t2": (0.4, "s1"), "u": (0.36, "s2")}


def test_metrics(spark):
    golden = spark.createDataFrame([(1, "HIT"), (2, "none"), (3, "hit")], "query_id int, expected string")
    ranked = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "xx:hit:yy"), (3, 0, "hit")], "query_id int, rank int, node_id string")
    got = {r.query_id: (r.first_hit, r.recall_at_1, r.recall_at_5, round(r.mrr, 6), round(r.ndcg, 6)) for r in evaluation.query_metrics(golden, ranked).collect()}
    assert got == {1: (3, 0.0, 1.0, 0.333333, 0.5), 2: (None, 0.0, 0.0, 0.0, 0.0), 3: (1, 1.0, 1.0, 1.0, 1.0)}
    assert evaluation.sweep_grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}] and evaluation.sweep_grid({}) == [{}]
    best = evaluation.best_combination(spark.createDataFrame([(0, 0.5, 0.9), (1, 0.6, 0.1), (2, 0.6, 0.1)], "combo int, recall_at_5 double, mrr double"))
    assert best.first().combo == 1 and evaluation.passes(0.5, None) and not evaluation.passes(0.5, 0.6)


def test_jaccard_neighbours_reads_whole_contents(spark, rows, tmp_path):
    from lodestrata.plans.text_queries import jaccard_neighbours

    same = "word " * 100
    nodes = [("s", "a", same + "left both"), ("s", "b", same + "right both"), ("s", "c", None)]
    spark.createDataFrame(nodes, "slug string, id string, content string").write.parquet(f"{tmp_path}/nodes.parquet")
    edges = [("s", "a", "b", "CALLS"), ("s", "a", "c", "CALLS"), ("s", "b", "a", "EXTENDS")]
    spark.createDataFrame(edges, "slug string, source_id string, target_id string, edge_type string").write.parquet(f"{tmp_path}/edges.parquet")
    assert rows(jaccard_neighbours(spark, str(tmp_path))) == [("s", "a", "b", 0.5), ("s", "a", "c", 0.0)]
