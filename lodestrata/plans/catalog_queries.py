"""Queries of versions, change sets, statistics and differences over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import catalog as C
from lodestrata.operators import diffing as D
from lodestrata.operators import evaluation as E
from lodestrata.operators.lexical import bm25, build_index
from lodestrata.session import staged, table


def latest_versions(spark, d):
    return C.latest_versions(table(spark, d, "version_meta")).select("patchline", "slug", "version_date", "build_number")


def prune_candidates(spark, d):
    return C.prune_candidates(table(spark, d, "version_meta"), 1)


def resolve_versions(spark, d):
    meta = table(spark, d, "version_meta")
    refs = meta.select(F.explode(F.array("slug", "short_hash", F.col("build_number").cast("string"), F.concat(F.lit("b"), F.col("build_number").cast("string")), F.lit("nope"))).alias("ref"))
    return C.resolve_versions(meta, refs)


def corpus_stats(spark, d):
    return C.stats_nodes(table(spark, d, "nodes"))


def edge_stats(spark, d):
    return C.stats_edges(table(spark, d, "edges"), table(spark, d, "nodes"))


def edges_first_wins(spark, d):
    edges = table(spark, d, "edges").filter("source_id is not null and target_id is not null").dropDuplicates(["id"])
    return C.first_wins(edges, ["slug", "source_id", "target_id", "edge_type"], "id").select("slug", "id", "source_id", "target_id", "edge_type")


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    """The nodes of the version before the newest release and of the newest, as states; which versions they are is one aggregation over version_meta."""
    nodes = table(spark, d, "nodes")
    order = [r["slug"] for r in table(spark, d, "version_meta").filter("patchline = 'release'").orderBy("version_date", "build_number").select("slug").collect()]
    return D.node_states(nodes, order[-2]), D.node_states(nodes, order[-1])


def nodes_upsert(spark, d):
    old, new = _snapshots(spark, d)
    return C.upsert(old, new, ["id"]).select("id", "corpus", F.md5(F.coalesce("content", F.lit(""))).alias("content"))


def delete_by_owner(spark, d):
    """Edges whose owning file the newest delivery doesn't have any more."""
    edges = table(spark, d, "edges").select("slug", "id", F.col("owning_file_id").alias("file_path")).distinct()
    return C.delete_by_key(edges, C.current_files(table(spark, d, "file_hashes")), ["slug", "file_path"])


def numbered_ids(spark, d):
    rows = table(spark, d, "nodes").filter("id is not null and display_name is not null").select("slug", "id", "display_name").distinct()
    return C.numbered_ids(rows, "display_name", ["id"], ["slug"])


def change_set(spark, d):
    """Files of each snapshot against all snapshots' last state before: here the newest release against the one before."""
    files = C.current_files(table(spark, d, "file_hashes"))
    order = [r["slug"] for r in table(spark, d, "version_meta").filter("patchline = 'release'").orderBy("version_date", "build_number").select("slug").collect()]
    return C.change_set(files.filter(F.col("slug") == order[-1]), files.filter(F.col("slug") == order[-2]), ["corpus_type", "file_path"], "file_hash")


def may_skip(spark, d):
    return C.may_skip(change_set(spark, d), ["corpus_type"])


def cache_lookup(spark, d):
    return C.cache_lookup(table(spark, d, "nodes"), table(spark, d, "embedding_cache"), "embedding_text", "orrin-text")


def source_priority(spark, d):
    return C.source_priority(table(spark, d, "documents"))


def stem_targets(spark, d):
    nodes = table(spark, d, "nodes")
    stems = table(spark, d, "edges").filter("target_id like 'gamedata:%'").select("slug", F.regexp_extract("target_id", r":([^:]*)$", 1).alias("stem"))
    return C.stem_targets(stems, nodes)


def glob_members(spark, d):
    """Names of each type that its first letters, as globs, take in, without one exception a type."""
    nodes = table(spark, d, "nodes").filter("corpus = 'gamedata' and display_name is not null and data_type is not null")
    rules = nodes.groupBy("data_type").agg(F.min("display_name").alias("least")).select(F.col("data_type").alias("group_id"), F.explode(F.array(F.struct(F.concat(F.substring("least", 1, 3), F.lit("*")).alias("glob"), F.lit(False).alias("exclude")), F.struct(F.lit("*_Gate").alias("glob"), F.lit(False).alias("exclude")), F.struct(F.col("least").alias("glob"), F.lit(True).alias("exclude")))).alias("x")).select("group_id", "x.glob", "x.exclude")
    return C.glob_members(rules, nodes.select(F.col("display_name").alias("name")).distinct())


def version_diff(spark, d):
    return D.version_diff(*_snapshots(spark, d))


def version_diff_summary(spark, d):
    return D.summary(D.version_diff(*_snapshots(spark, d)))


def cross_references(spark, d):
    order = [r["slug"] for r in table(spark, d, "version_meta").filter("patchline = 'release'").orderBy("version_date", "build_number").select("slug").collect()]
    return D.cross_references(D.version_diff(*_snapshots(spark, d)), table(spark, d, "edges").filter(F.col("slug") == order[-1]))


def patch_notes(spark, d):
    return D.patch_notes(D.version_diff(*_snapshots(spark, d)), table(spark, d, "documents").select("doc_id", "text", "title"))


def json_fields(spark, d):
    nodes = table(spark, d, "nodes").filter("id is not null and metadata is not null").select("slug", "id", "metadata").distinct()
    return D.flatten_json(nodes, ["slug", "id"], "metadata").distinct()


def json_field_changes(spark, d):
    """Field changes of gamedata between the last two releases."""
    old, new = (D.flatten_json(s.filter("corpus = 'gamedata'"), ["id"], "content") for s in _snapshots(spark, d))
    return D.field_changes(old, new, ["id"])


def retrieval_metrics(spark, d):
    """Each class of the newest release is asked for by its own name, and expected to be found."""
    nodes = table(spark, d, "nodes")
    slug = C.latest_versions(table(spark, d, "version_meta")).filter("patchline = 'release'").select("slug")
    mine = nodes.join(F.broadcast(slug), "slug", "left_semi")
    asked = mine.filter("node_type = 'JavaClass'").select(F.col("id").alias("query_id"), F.col("display_name").alias("query"), F.col("id").alias("expected")).filter("query is not null").dropDuplicates(["query_id"])
    found = bm25(staged(build_index(mine)), asked.select("query_id", "query"), limit=10)
    return E.mean_metrics(E.query_metrics(asked.select("query_id", "expected"), found.select("query_id", "rank", "node_id")))


QUERIES = {
    f.__name__: f
    for f in (
        latest_versions, prune_candidates, resolve_versions, corpus_stats, edge_stats, edges_first_wins, nodes_upsert, delete_by_owner, numbered_ids, change_set, may_skip, cache_lookup, source_priority, stem_targets, glob_members,
        version_diff, version_diff_summary, cross_references, patch_notes, json_fields, json_field_changes, retrieval_metrics,
    )
}

_NEWEST = "version_date DESC NULLS LAST, indexed_at DESC NULLS LAST, build_number DESC NULLS LAST, slug DESC"
_V = "v AS (SELECT DISTINCT * FROM version_meta)"
_PATH = r"nullif(regexp_replace(replace(file_path, '\', '/'), '^(?:\./)+', ''), '')"
_FILES = f"files AS (SELECT slug, corpus_type, p AS file_path, arg_max(h, (indexed_at, batch_id, h)) AS file_hash FROM (SELECT slug, corpus_type, {_PATH} AS p, nullif(lower(file_hash), '') AS h, indexed_at, batch_id FROM file_hashes) WHERE p IS NOT NULL AND h IS NOT NULL GROUP BY ALL)"
_SLUG = "(SELECT slug FROM version_meta WHERE patchline = 'release' ORDER BY version_date DESC, build_number DESC LIMIT 1 OFFSET {0})"
_CHANGE_SET = f"{_FILES}, c AS (SELECT coalesce(a.corpus_type, b.corpus_type) AS corpus_type, coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN b.file_path IS NULL THEN 'ADDED' WHEN a.file_path IS NULL THEN 'DELETED' WHEN a.file_hash = b.file_hash THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM (SELECT * FROM files WHERE slug = {_SLUG.format(0)}) a FULL JOIN (SELECT * FROM files WHERE slug = {_SLUG.format(1)}) b ON a.corpus_type = b.corpus_type AND a.file_path = b.file_path)"
_STATE = "(SELECT id, any_value(corpus) AS corpus, any_value(data_type) AS data_type, any_value(display_name) AS display_name, any_value(content) AS content, any_value(published_date) AS published_date FROM nodes WHERE slug = {0} AND id IS NOT NULL GROUP BY id)"
_SIG = "coalesce(list_filter(list_transform(string_split(coalesce({0}, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(//|/\\*|\\*|@)'))[1], '')"
_DIFF = f"""o AS {_STATE.format(_SLUG.format(1))}, n AS {_STATE.format(_SLUG.format(0))}, both_ AS (SELECT DISTINCT corpus FROM o INTERSECT SELECT DISTINCT corpus FROM n),
j AS (SELECT coalesce(n.id, o.id) AS id, coalesce(n.corpus, o.corpus) AS corpus, coalesce(n.data_type, o.data_type) AS data_type, coalesce(n.display_name, o.display_name) AS display_name, o.content AS oc, n.content AS nc,
  CASE WHEN o.id IS NULL THEN 'ADDED' WHEN n.id IS NULL THEN 'REMOVED' WHEN o.content IS DISTINCT FROM n.content THEN 'CHANGED' WHEN n.corpus = 'docs' AND (o.display_name IS DISTINCT FROM n.display_name OR o.published_date IS DISTINCT FROM n.published_date) THEN 'CHANGED' END AS change,
  o.display_name AS ot, n.display_name AS nt, o.published_date AS od, n.published_date AS nd
  FROM (SELECT * FROM o WHERE corpus IN (FROM both_)) o FULL JOIN (SELECT * FROM n WHERE corpus IN (FROM both_)) n ON o.id = n.id),
diff AS (SELECT id, change, corpus, data_type, display_name,
  CASE WHEN contains(lower(id), 'protocol') THEN 'HIGH' WHEN corpus = 'gamedata' AND change IN ('ADDED', 'REMOVED') THEN 'HIGH' WHEN corpus = 'code' AND change IN ('ADDED', 'REMOVED') THEN 'MEDIUM' WHEN corpus IN ('gamedata', 'client') THEN 'MEDIUM' ELSE 'LOW' END AS significance,
  CASE WHEN change <> 'CHANGED' THEN NULL WHEN corpus = 'code' THEN CASE WHEN {_SIG.format('oc')} <> {_SIG.format('nc')} THEN 'signature' ELSE 'body' END
    WHEN corpus = 'docs' THEN concat_ws(',', CASE WHEN oc IS DISTINCT FROM nc THEN 'body' END, CASE WHEN ot IS DISTINCT FROM nt THEN 'title' END, CASE WHEN od IS DISTINCT FROM nd THEN 'date' END) WHEN corpus = 'gamedata' THEN 'fields' ELSE 'content' END AS detail,
  CASE change WHEN 'ADDED' THEN 0 WHEN 'REMOVED' THEN 1 ELSE 2 END AS place FROM j WHERE change IS NOT NULL)"""

SQL = {
    "latest_versions": f"WITH {_V} SELECT patchline, slug, version_date, build_number FROM v QUALIFY row_number() OVER (PARTITION BY patchline ORDER BY {_NEWEST}) = 1",
    "prune_candidates": f"WITH {_V} SELECT patchline, slug, row_number() OVER (PARTITION BY patchline ORDER BY {_NEWEST}) AS age FROM v QUALIFY age > 1",
    "resolve_versions": f"""WITH {_V}, refs AS (SELECT slug AS ref FROM v UNION SELECT short_hash FROM v UNION SELECT CAST(build_number AS VARCHAR) FROM v UNION SELECT 'b' || build_number FROM v UNION SELECT 'nope'),
hits AS (SELECT ref, v.* FROM refs JOIN v ON ref IN (slug, short_hash, CAST(build_number AS VARCHAR), 'b' || build_number, version_date, regexp_extract(slug, '_(b\\d+_.*)$', 1)) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY {_NEWEST}) = 1)
SELECT refs.ref, hits.slug FROM refs LEFT JOIN hits ON hits.ref = refs.ref""",
    "corpus_stats": "SELECT slug, corpus, kind, count(*) AS n FROM (SELECT DISTINCT slug, id, corpus, coalesce(data_type, node_type) AS kind FROM nodes WHERE id IS NOT NULL) GROUP BY ALL",
    "edge_stats": "SELECT e.slug, corpus, edge_type, count(*) AS n FROM (SELECT DISTINCT slug, id, source_id, edge_type FROM edges) e JOIN (SELECT DISTINCT slug, id, corpus FROM nodes) h ON h.slug = e.slug AND h.id = e.source_id GROUP BY ALL",
    "edges_first_wins": "SELECT slug, min(id) AS id, source_id, target_id, edge_type FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL",
    "nodes_upsert": f"WITH o AS {_STATE.format(_SLUG.format(1))}, n AS {_STATE.format(_SLUG.format(0))} SELECT id, corpus, md5(coalesce(content, '')) AS content FROM (SELECT id, corpus, content FROM n UNION ALL SELECT id, corpus, content FROM o WHERE id NOT IN (SELECT id FROM n))",
    "delete_by_owner": f"WITH {_FILES} SELECT DISTINCT slug, id, owning_file_id AS file_path FROM edges e WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.slug = e.slug AND f.file_path = e.owning_file_id)",
    "numbered_ids": "SELECT slug, id, CASE WHEN r > 1 THEN display_name || '~' || r ELSE display_name END AS display_name FROM (SELECT *, row_number() OVER (PARTITION BY slug, display_name ORDER BY id) AS r FROM (SELECT DISTINCT slug, id, display_name FROM nodes WHERE id IS NOT NULL AND display_name IS NOT NULL))",
    "change_set": f"WITH {_CHANGE_SET} SELECT * FROM c",
    "may_skip": f"WITH {_CHANGE_SET} SELECT corpus_type, count(*) FILTER (status <> 'UNCHANGED') = 0 AND count(*) FILTER (status = 'UNCHANGED') > 0 AS skip, count(*) FILTER (status IN ('ADDED', 'CHANGED')) AS n_changed FROM c GROUP BY ALL",
    "cache_lookup": "SELECT h AS content_hash, h IN (SELECT content_hash FROM embedding_cache WHERE model_id = 'orrin-text' AND vector IS NOT NULL AND content_hash IS NOT NULL) AS hit FROM (SELECT DISTINCT sha256(embedding_text) AS h FROM nodes WHERE embedding_text IS NOT NULL)",
    "source_priority": "SELECT doc_id, source, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY coalesce(list_position(['repo', 'modding', 'support', 'blog', 're', 'local'], source), 7), doc_id) = 1",
    "stem_targets": "SELECT s.slug, stem, node_id, count(*) OVER (PARTITION BY s.slug, stem) > 1 AS multi_match FROM (SELECT DISTINCT slug, regexp_extract(target_id, ':([^:]*)$', 1) AS stem FROM edges WHERE target_id LIKE 'gamedata:%') s JOIN (SELECT DISTINCT slug, id AS node_id, lower(display_name) AS k FROM nodes WHERE id IS NOT NULL AND display_name IS NOT NULL) h ON h.slug = s.slug AND h.k = lower(stem)",
    "glob_members": """WITH n AS (SELECT DISTINCT display_name, data_type FROM nodes WHERE corpus = 'gamedata' AND display_name IS NOT NULL AND data_type IS NOT NULL), g AS (SELECT data_type AS group_id, min(display_name) AS least FROM n GROUP BY ALL)
SELECT DISTINCT group_id, display_name AS name FROM g, n WHERE (starts_with(display_name, substring(least, 1, 3)) OR ends_with(display_name, '_Gate')) AND display_name <> least""",
    "version_diff": f"WITH {_DIFF} SELECT * FROM diff",
    "version_diff_summary": f"WITH {_DIFF} SELECT corpus, count(*) FILTER (change = 'ADDED') AS added, count(*) FILTER (change = 'REMOVED') AS removed, count(*) FILTER (change = 'CHANGED') AS changed FROM diff GROUP BY ALL",
    "cross_references": f"""WITH {_DIFF}, u AS (SELECT source_id, target_id, edge_type, min(id) AS seq FROM edges WHERE slug = {_SLUG.format(0)} AND source_id IS NOT NULL AND target_id IS NOT NULL AND edge_type IS NOT NULL GROUP BY ALL),
ends AS (SELECT source_id AS id, target_id AS other_id, edge_type, seq FROM u UNION ALL SELECT target_id, source_id, edge_type, seq FROM u)
SELECT id, other_id, edge_type, row_number() OVER (PARTITION BY id ORDER BY seq, other_id, edge_type) AS rank FROM ends WHERE id IN (SELECT id FROM diff WHERE corpus = 'gamedata' AND change IN ('ADDED', 'CHANGED')) QUALIFY rank <= 5""",
    "patch_notes": f"""WITH {_DIFF}, names AS (SELECT DISTINCT lower(display_name) AS name FROM diff WHERE significance = 'HIGH' AND length(display_name) >= 4),
w AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}]+)', 1) AS words FROM documents WHERE text IS NOT NULL)
SELECT name, doc_id, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS rank FROM names JOIN w ON contains(low, name) AND list_contains(words, regexp_extract(name, '([\\p{{L}}\\p{{N}}]+)', 1)) QUALIFY rank <= 3""",
}
