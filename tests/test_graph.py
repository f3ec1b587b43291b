import pytest

from lodestrata.operators import graph as G

EDGES = "slug string, id bigint, source_id string, target_id string, edge_type string, rank int"
NODES = "slug string, id string, node_type string, display_name string, corpus string, content string, line_start int, metadata string"


def edges(spark, data):
    return spark.createDataFrame([("v", n, a, b, t, 0) for n, (a, b, t) in enumerate(data)], EDGES)


def nodes(spark, data):
    return spark.createDataFrame([("v", i, t, name, c, None, n, None) for n, (i, t, name, c) in enumerate(data)], NODES)


@pytest.fixture(scope="module")
def game(spark):
    names = ["item:torch", "item:log", "item:resin", "drop:goblin", "item:coin", "npc:goblin", "npc:archer", "group:party", "recipe:torch", "shop:smith"]
    n = nodes(spark, [(f"gamedata:{x}", "GameData", x.split(":")[1].title(), "gamedata") for x in names] + [("ui:Craft.ui", "ui", "Craft", "client"), ("gamedata:item:torch", "GameData", "Torch", "gamedata")])
    g = "gamedata:"
    e = edges(spark, [(g + "item:torch", g + "item:log", "REQUIRES_ITEM"), (g + "item:torch", g + "item:resin", "REQUIRES_ITEM"), (g + "item:torch", "virtual:resource:Resin", "REQUIRES_ITEM"), (g + "npc:goblin", g + "drop:goblin", "DROPS_ON_DEATH"), (g + "drop:goblin", g + "item:coin", "DROPS_ITEM"), (g + "group:party", g + "npc:goblin", "HAS_MEMBER"), (g + "group:party", g + "npc:archer", "HAS_MEMBER"), (g + "recipe:torch", g + "item:log", "REQUIRES_ITEM"), (g + "recipe:torch", g + "item:torch", "PRODUCES_ITEM"), ("ui:Craft.ui", g + "item:torch", "UI_BINDS_TO"), (g + "item:torch", g + "item:log", "REQUIRES_ITEM"), (None, g + "item:log", "REQUIRES_ITEM")])
    return e, n


def test_neighbours_skip_virtual_ends_and_copies(game, rows):
    got = rows(G.neighbours(*game, ["REQUIRES_ITEM"], True).filter("seed_id = 'gamedata:item:torch'").select("node_id", "rank"))
    assert got == [("gamedata:item:log", 1), ("gamedata:item:resin", 2)]
    assert rows(G.neighbours(*game, ["REQUIRES_ITEM"], True, limit=1).filter("seed_id = 'gamedata:item:torch'").select("node_id")) == [("gamedata:item:log",)]


def test_both_ways_two_hops_and_dangling(game, rows):
    assert rows(G.both_ways(*game, "PRODUCES_ITEM").filter("seed_id like '%torch'").select("seed_id", "node_id", "score")) == [("gamedata:item:torch", "gamedata:recipe:torch", 0.9), ("gamedata:recipe:torch", "gamedata:item:torch", 1.0)]
    assert rows(G.two_hops(*game, "DROPS_ON_DEATH", "DROPS_ITEM").select("seed_id", "node_id")) == [("gamedata:npc:goblin", "gamedata:item:coin")]
    out = rows(G.node_edges(*game).filter("other_id like 'virtual:%'").select("seed_id", "direction", "other_name"))
    assert out == [("gamedata:item:torch", "out", None)]
    assert rows(G.neighbours(game[0].limit(0), game[1], ["REQUIRES_ITEM"], True)) == []


CODE = [("a.A#m", "JavaMethod", "A#m", "code"), ("b.B#m", "JavaMethod", "B#m", "code"), ("c.Foo#bar", "JavaMethod", "Foo#bar", "code"), ("class:c.Foo", "JavaClass", "Foo", "code"), ("class:x.Bar", "JavaClass", "Bar", "code"), ("class:x.Base", "JavaClass", "Base", "code"), ("class:x.Sub", "JavaClass", "Sub", "code"), ("class:x.Leaf", "JavaClass", "Leaf", "code"), ("x.Base#build", "JavaMethod", "Base#build", "code"), ("x.Base#reset", "JavaMethod", "Base#reset", "code"), ("x.Sub#build", "JavaMethod", "Sub#build", "code"), ("x.Sub#build~2", "JavaMethod", "Sub#build", "code")]


def code(spark):
    return edges(spark, [("a.A#m", "c.Foo#bar", "CALLS"), ("b.B#m", "class:c.Foo", "CALLS"), ("a.A#m", "x.Bar#init", "CALLS"), ("class:x.Sub", "class:x.Base", "EXTENDS"), ("class:x.Leaf", "class:x.Sub", "EXTENDS"), ("class:x.Base", "class:x.Sub", "EXTENDS")]), nodes(spark, CODE)


def test_callers_and_callees(spark, rows):
    e, n = code(spark)
    got = rows(G.callers(e, n).select("seed_id", "node_id"))
    assert ("class:c.Foo", "a.A#m") in got and ("class:c.Foo", "b.B#m") in got and ("c.Foo#bar", "b.B#m") in got
    assert rows(G.callees(e, n).select("seed_id", "node_id")) == [("a.A#m", "c.Foo#bar"), ("a.A#m", "class:x.Bar"), ("b.B#m", "class:c.Foo")]


def test_walk_stops_at_depth_survives_cycles_and_keeps_the_first_way(spark, rows):
    e, n = code(spark)
    seeds = spark.createDataFrame([("v", "class:x.Leaf")], "slug string, seed_id string")
    up = rows(G.related(e, n, seeds, ["EXTENDS"], "up", 3).select("node_id", "depth"))
    assert up == [("class:x.Base", 2), ("class:x.Sub", 1)]
    assert rows(G.related(e, n, seeds, None, "down", 2)) == []
    assert len(rows(G.related(e, n, seeds, None, "both", 3, limit=1))) == 1
    with pytest.raises(ValueError):
        G.related(e, n, seeds, depth=4)


def test_by_relation_falls_back_only_if_nothing_leads_there(spark, rows):
    e, n = code(spark)
    names = spark.createDataFrame([("v", "sub"), ("v", "Leaf"), ("v", "Nope")], "slug string, name string")
    assert rows(G.by_relation(e, n, names, "EXTENDS").select("name", "node_id", "score")) == [("Leaf", "class:x.Sub", 0.9), ("sub", "class:x.Base", 1.0), ("sub", "class:x.Leaf", 1.0)]


def test_resolution(spark, rows):
    e, n = code(spark)
    refs = spark.createDataFrame([("v", r) for r in ("class:c.Foo", "Bar", "Sub#build", "nothing")], "slug string, ref string")
    got = {r.ref: (r.resolution, r.node_id, r.n_candidates) for r in G.resolve_ids(n, refs).collect()}
    assert got == {"class:c.Foo": ("exact", "class:c.Foo", 1), "Bar": ("name", "class:x.Bar", 1), "Sub#build": ("ambiguous", "x.Sub#build", 2), "nothing": ("none", None, 0)}
    assert G.name_suggestions(n, "oo").count() == 2


def test_methods_shadow_and_overloads_stay(spark, rows):
    e, n = code(spark)
    got = rows(G.class_methods(e, n).filter("class_id = 'class:x.Leaf'").select("node_id", "inherited_from"))
    assert got == [("x.Base#reset", "class:x.Base"), ("x.Sub#build", "class:x.Sub"), ("x.Sub#build~2", "class:x.Sub")]
