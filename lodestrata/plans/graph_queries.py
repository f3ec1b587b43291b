"""Graph queries over all seeds of all snapshots, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import graph as G
from lodestrata.session import table


def _both(spark, d):
    return table(spark, d, "edges"), table(spark, d, "nodes")


_HEADS = """u AS (SELECT slug, source_id, target_id, edge_type, min(id) AS seq FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND edge_type IS NOT NULL GROUP BY ALL),
heads AS (SELECT slug, id, any_value(node_type) AS node_type, any_value(display_name) AS display_name, any_value(corpus) AS corpus, any_value(line_start) AS line_start, any_value(metadata) AS metadata FROM nodes WHERE id IS NOT NULL GROUP BY slug, id)"""


def _one_hop(edge_type: str, outgoing: bool, condition: str = "true", limit: int | None = 10) -> str:
    here, there = ("source_id", "target_id") if outgoing else ("target_id", "source_id")
    cap = f"WHERE rank <= {limit}" if limit else ""
    return f"""WITH {_HEADS}, hits AS (SELECT u.slug, u.{here} AS seed_id, h.id AS node_id, u.edge_type, h.node_type, h.display_name, h.corpus,
  row_number() OVER (PARTITION BY u.slug, u.{here} ORDER BY u.seq, h.id) AS rank FROM u JOIN heads h ON h.slug = u.slug AND h.id = u.{there} WHERE u.edge_type = '{edge_type}' AND {condition})
SELECT * FROM hits {cap}"""


#: The tables have no OFFERED_IN_SHOP and DROPS_ON_DEATH edges; REQUIRES_ITEM stands in for them in shops_selling and drops_two_hop.
_HOPS = {
    "implementing_code": ("IMPLEMENTED_BY", True, "node_type = 'JavaClass'", 10),
    "gamedata_for_code": ("IMPLEMENTED_BY", False, "corpus = 'gamedata'", 5),
    "shops_selling": ("REQUIRES_ITEM", False, "corpus = 'gamedata'", 10),
    "group_members": ("HAS_MEMBER", True, "corpus = 'gamedata'", 10),
    "ui_bindings": ("UI_BINDS_TO", True, "corpus = 'gamedata'", 10),
    "ui_for_gamedata": ("UI_BINDS_TO", False, "corpus = 'client'", 10),
    "docs_references": ("DOCS_REFERENCES", True, "corpus IN ('code', 'gamedata')", 10),
}


def _hop_query(edge_type, outgoing, condition, limit):
    return lambda spark, d: G.neighbours(*_both(spark, d), [edge_type], outgoing, condition=F.expr(condition), limit=limit)


def callers(spark, d):
    return G.callers(*_both(spark, d))


def callees(spark, d):
    return G.callees(*_both(spark, d))


def recipe_inputs(spark, d):
    return G.both_ways(*_both(spark, d), "REQUIRES_ITEM")


def recipe_outputs(spark, d):
    return G.both_ways(*_both(spark, d), "PRODUCES_ITEM")


def drops_two_hop(spark, d):
    return G.two_hops(*_both(spark, d), "REQUIRES_ITEM", "DROPS_ITEM")


def node_neighbours(spark, d):
    return G.node_edges(*_both(spark, d))


def related_bfs(spark, d):
    edges, nodes = _both(spark, d)
    return G.related(edges, nodes, G.all_seeds(nodes, F.col("node_type") == "JavaClass"), ["EXTENDS", "IMPLEMENTS", "INSTANCEOF"], "both", 2)


def by_relation(spark, d):
    edges, nodes = _both(spark, d)
    return G.by_relation(edges, nodes, nodes.filter("node_type = 'JavaClass'").select("slug", F.col("display_name").alias("name")).filter("name is not null"), "EXTENDS")


def resolve_node_ids(spark, d):
    nodes = table(spark, d, "nodes")
    refs = nodes.select("slug", F.col("display_name").alias("ref")).unionByName(table(spark, d, "edges").select("slug", F.col("target_id").alias("ref"))).filter("ref is not null and ref <> ''")
    return G.resolve_ids(nodes, refs)


def name_suggestions(spark, d):
    return G.name_suggestions(table(spark, d, "nodes"), "Router")


def class_methods(spark, d):
    return G.class_methods(*_both(spark, d))


QUERIES = {name: _hop_query(*spec) for name, spec in _HOPS.items()} | {f.__name__: f for f in (callers, callees, recipe_inputs, recipe_outputs, drops_two_hop, node_neighbours, related_bfs, by_relation, resolve_node_ids, name_suggestions, class_methods)}

_CLASS = "'class:' || regexp_replace(split_part({0}, '#', 1), '^class:', '')"


def _both_ways(edge_type: str) -> str:
    return f"""WITH {_HEADS}, hits AS (
  SELECT u.slug, source_id AS seed_id, id AS node_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY u.slug, source_id ORDER BY seq, id) AS r FROM u JOIN heads h ON h.slug = u.slug AND h.id = target_id WHERE edge_type = '{edge_type}'
  UNION ALL SELECT u.slug, target_id, id, 0.9::DOUBLE, row_number() OVER (PARTITION BY u.slug, target_id ORDER BY seq, id) FROM u JOIN heads h ON h.slug = u.slug AND h.id = source_id WHERE edge_type = '{edge_type}')
SELECT slug, seed_id, node_id, max(score) AS score FROM hits WHERE r <= 10 GROUP BY ALL"""


SQL = {name: _one_hop(*spec) for name, spec in _HOPS.items()} | {
    "callers": f"""WITH {_HEADS}, calls AS (SELECT * FROM u WHERE edge_type = 'CALLS'), seeds AS (SELECT DISTINCT slug, id AS seed_id FROM nodes WHERE corpus = 'code' AND id IS NOT NULL),
reach AS (SELECT slug, seed_id, seed_id AS target_id FROM seeds UNION SELECT slug, seed_id, {_CLASS.format('seed_id')} FROM seeds
  UNION SELECT s.slug, s.seed_id, c.target_id FROM seeds s JOIN calls c ON c.slug = s.slug AND contains(c.target_id, '#') AND {_CLASS.format('c.target_id')} = s.seed_id),
hits AS (SELECT r.slug, seed_id, source_id AS node_id, min(seq) AS seq FROM reach r JOIN calls c ON c.slug = r.slug AND c.target_id = r.target_id GROUP BY ALL),
ranked AS (SELECT t.slug, seed_id, node_id, display_name, row_number() OVER (PARTITION BY t.slug, seed_id ORDER BY seq, node_id) AS rank FROM hits t JOIN heads h ON h.slug = t.slug AND h.id = node_id)
SELECT * FROM ranked WHERE rank <= 10""",
    "callees": f"""WITH {_HEADS}, hits AS (SELECT u.slug, source_id AS seed_id, coalesce(a.id, b.id) AS node_id, CASE WHEN a.display_name IS NOT NULL THEN a.display_name ELSE b.display_name END AS display_name, min(seq) AS seq
  FROM u LEFT JOIN heads a ON a.slug = u.slug AND a.id = target_id LEFT JOIN heads b ON b.slug = u.slug AND b.id = {_CLASS.format('target_id')} WHERE edge_type = 'CALLS' AND coalesce(a.id, b.id) IS NOT NULL GROUP BY ALL),
ranked AS (SELECT slug, seed_id, node_id, display_name, row_number() OVER (PARTITION BY slug, seed_id ORDER BY seq, node_id) AS rank FROM hits)
SELECT * FROM ranked WHERE rank <= 10""",
    "recipe_inputs": _both_ways("REQUIRES_ITEM"),
    "recipe_outputs": _both_ways("PRODUCES_ITEM"),
    "drops_two_hop": f"""WITH {_HEADS}, hits AS (SELECT a.slug, a.source_id AS seed_id, b.target_id AS node_id, min((a.seq, b.seq)) AS seq FROM u a JOIN u b ON b.slug = a.slug AND b.source_id = a.target_id WHERE a.edge_type = 'REQUIRES_ITEM' AND b.edge_type = 'DROPS_ITEM' GROUP BY ALL),
ranked AS (SELECT t.slug, seed_id, node_id, display_name, row_number() OVER (PARTITION BY t.slug, seed_id ORDER BY seq, node_id) AS rank FROM hits t JOIN heads h ON h.slug = t.slug AND h.id = node_id)
SELECT * FROM ranked WHERE rank <= 10""",
    "node_neighbours": f"""WITH {_HEADS}, long AS (SELECT slug, 'out' AS direction, source_id AS seed_id, edge_type, target_id AS other_id FROM u UNION ALL SELECT slug, 'in', target_id, edge_type, source_id FROM u)
SELECT l.slug, l.seed_id, direction, edge_type, other_id, o.display_name AS other_name FROM long l JOIN heads h ON h.slug = l.slug AND h.id = l.seed_id LEFT JOIN heads o ON o.slug = l.slug AND o.id = other_id""",
    "related_bfs": f"""WITH {_HEADS}, steps AS (SELECT s.* FROM (SELECT slug, source_id AS at_id, target_id AS node_id, edge_type, seq FROM u WHERE edge_type IN ('EXTENDS', 'IMPLEMENTS', 'INSTANCEOF') UNION ALL SELECT slug, target_id, source_id, edge_type, seq FROM u WHERE edge_type IN ('EXTENDS', 'IMPLEMENTS', 'INSTANCEOF')) s JOIN heads h ON h.slug = s.slug AND h.id = s.node_id),
seeds AS (SELECT DISTINCT slug, id AS seed_id FROM nodes WHERE node_type = 'JavaClass' AND id IS NOT NULL),
one AS (SELECT s.slug, seed_id, node_id, 1 AS depth, arg_min(edge_type, (seq, edge_type)) AS edge_type FROM seeds s JOIN steps t ON t.slug = s.slug AND t.at_id = s.seed_id WHERE node_id <> seed_id GROUP BY s.slug, seed_id, node_id),
two AS (SELECT o.slug, o.seed_id, t.node_id, 2 AS depth, arg_min(t.edge_type, (seq, t.edge_type)) AS edge_type FROM one o JOIN steps t ON t.slug = o.slug AND t.at_id = o.node_id
  WHERE t.node_id <> o.seed_id AND NOT EXISTS (SELECT 1 FROM one x WHERE x.slug = o.slug AND x.seed_id = o.seed_id AND x.node_id = t.node_id) GROUP BY o.slug, o.seed_id, t.node_id)
SELECT * FROM one UNION ALL SELECT * FROM two""",
    "by_relation": f"""WITH {_HEADS}, names AS (SELECT DISTINCT slug, display_name AS name FROM nodes WHERE node_type = 'JavaClass' AND display_name IS NOT NULL), k AS (SELECT * FROM u WHERE edge_type = 'EXTENDS'),
fwd AS (SELECT DISTINCT n.slug, name, source_id AS node_id, 1.0::DOUBLE AS score FROM names n JOIN k ON k.slug = n.slug AND (lower(target_id) = lower('class:' || name) OR (starts_with(target_id, 'class:') AND ends_with(lower(target_id), lower('.' || name)))) AND NOT contains(target_id, '#') JOIN heads h ON h.slug = n.slug AND h.id = source_id),
back AS (SELECT DISTINCT n.slug, name, target_id AS node_id, 0.9::DOUBLE AS score FROM names n JOIN k ON k.slug = n.slug AND (lower(source_id) = lower('class:' || name) OR (starts_with(source_id, 'class:') AND ends_with(lower(source_id), lower('.' || name)))) AND NOT contains(source_id, '#') JOIN heads h ON h.slug = n.slug AND h.id = target_id
  WHERE NOT EXISTS (SELECT 1 FROM fwd f WHERE f.slug = n.slug AND f.name = n.name))
SELECT * FROM fwd UNION ALL SELECT * FROM back""",
    "resolve_node_ids": f"""WITH {_HEADS}, refs AS (SELECT slug, display_name AS ref FROM nodes UNION SELECT slug, target_id FROM edges), asked AS (SELECT * FROM refs WHERE ref IS NOT NULL AND ref <> ''),
keys AS (SELECT slug, id, display_name AS ref FROM heads WHERE display_name <> '' UNION SELECT slug, id, regexp_extract(id, '\\.([^.]*)$', 1) FROM heads WHERE regexp_extract(id, '\\.([^.]*)$', 1) <> ''),
exact AS (SELECT a.slug, a.ref, 'exact' AS resolution, a.ref AS node_id, 1::BIGINT AS n_candidates FROM asked a JOIN heads h ON h.slug = a.slug AND h.id = a.ref),
rest AS (SELECT a.slug, a.ref, count(k.id) AS n, min(k.id) AS node_id FROM asked a LEFT JOIN keys k ON k.slug = a.slug AND k.ref = a.ref WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.slug = a.slug AND e.ref = a.ref) GROUP BY ALL)
SELECT * FROM exact UNION ALL SELECT slug, ref, CASE WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END, node_id, n FROM rest""",
    "name_suggestions": f"""WITH {_HEADS}, r AS (SELECT slug, id, display_name, row_number() OVER (PARTITION BY slug ORDER BY length(display_name) NULLS FIRST, id) AS rank FROM heads WHERE display_name ILIKE '%Router%' OR id ILIKE '%Router%')
SELECT * FROM r WHERE rank <= 10""",
}
