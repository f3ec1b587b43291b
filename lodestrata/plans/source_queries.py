"""Extraction, vectors, events and composed searches over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import embedding, graph, lexical, ranking
from lodestrata.plans.text_queries import _INDEX, _bm25, _searches
from lodestrata.session import staged, table
from lodestrata.sources import docs, files, json_records, ui
from lodestrata.streaming.ingest import event_counts


def classify_paths(spark, d):
    return table(spark, d, "nodes").filter("file_path is not null").select("file_path", files.data_type(F.col("file_path")).alias("found_type")).distinct()


def knn_cosine(spark, d):
    """The 10 nearest of each vector whose id is divisible by 100, among all."""
    rows = table(spark, d, "embeddings")
    return embedding.nearest(rows, rows.filter("vec_id % 100 = 0"), 10, round_to=9)


def docs_entity_edges(spark, d):
    """Docs that name code or gamedata of their own snapshot, in just that spelling."""
    nodes = table(spark, d, "nodes").filter("id is not null")
    told = nodes.filter("corpus = 'docs'").select("slug", F.col("id").alias("source_id"), "content").distinct()
    named = told.select("slug", "source_id", F.explode(docs.entity_candidates(F.coalesce("content", F.lit("")))).alias("display_name")).distinct()
    targets = nodes.filter("corpus in ('code', 'gamedata')").select("slug", F.col("id").alias("target_id"), "display_name").distinct()
    return named.join(targets, ["slug", "display_name"]).select("slug", "source_id", "target_id").distinct()


def ui_entity_edges(spark, d):
    """UI files bound to gamedata by what they hold, over all snapshots at once."""
    nodes = table(spark, d, "nodes").filter("id is not null")
    client = nodes.filter("corpus = 'client' and content is not null").select("id", "content", "display_name").distinct()
    return ui.ui_edges(client, nodes.filter("corpus = 'gamedata' and display_name is not null").select("id", "display_name").distinct()).select("source_id", "target_id", "confidence")


def game_data_nodes(spark, d):
    """Texts, related ids and parse errors of all game data."""
    rows = table(spark, d, "nodes").filter("corpus = 'gamedata' and content is not null and file_path is not null").select(F.col("file_path").alias("path"), "content").distinct()
    return json_records.game_nodes(rows).select("path", "data_type", "embedding_text", F.size("related").alias("n_related"), F.size("edges").alias("n_edges"), "error")


def game_data_edges(spark, d):
    rows = table(spark, d, "nodes").filter("corpus = 'gamedata' and content is not null and file_path is not null").select(F.col("file_path").alias("path"), "content").distinct()
    return json_records.game_edges(staged(json_records.game_nodes(rows).filter("error is null").dropDuplicates(["id"])))


def document_sections(spark, d):
    rows = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return docs.sections(rows)


def event_windows(spark, d):
    return event_counts(table(spark, d, "events")).select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def _seeds(spark, d, limit=20):
    index = staged(lexical.build_index(table(spark, d, "nodes")))
    return ranking.rrf(lexical.bm25(index, _searches(spark), limit=limit).withColumn("list_no", F.lit(0)), keys=("slug", "query_id"))


def expand_results(spark, d):
    """What the results' edges lead to in each snapshot, at a discount."""
    edges = graph.unique_edges(table(spark, d, "edges"))
    links = edges.select("slug", F.col("source_id").alias("seed_id"), F.col("target_id").alias("node_id"), "edge_type", "seq")
    seeds = _seeds(spark, d).select(F.concat_ws("|", "slug", "query_id").alias("query_id"), F.concat_ws("|", "slug", "node_id").alias("node_id"), "score")
    keyed = links.select(F.concat_ws("|", "slug", "seed_id").alias("seed_id"), F.concat_ws("|", "slug", "node_id").alias("node_id"), "edge_type", "seq")
    return ranking.expand(seeds, keyed).select("query_id", "node_id", F.round("score", 9).alias("score"), "bridged_from", "bridge_type")


def diversified_results(spark, d):
    """Results whose near duplicates are lowered."""
    heads = table(spark, d, "nodes").filter("id is not null").groupBy("slug", F.col("id").alias("node_id")).agg(F.max("display_name").alias("display_name"), F.max("content").alias("snippet"))
    rows = _seeds(spark, d).join(heads, ["slug", "node_id"]).select("slug", "query_id", "node_id", "display_name", "snippet", F.lit(False).alias("thin"), "score")
    return ranking.diversify(rows, keys=("slug", "query_id")).select("slug", "query_id", "node_id", F.round("score", 9).alias("score"))


def hybrid_search(spark, d):
    """The flagship: words and names of all nodes fused, weighed by corpus, the best ten of each query and snapshot."""
    index = staged(lexical.build_index(table(spark, d, "nodes")))
    lists = lexical.bm25(index, _searches(spark), limit=100, round_to=6).withColumn("list_no", F.lit(0)).unionByName(lexical.bm25(index, _searches(spark), limit=100, body_weight=0.0, round_to=6).withColumn("list_no", F.lit(1)))
    fused = ranking.rrf(lists, keys=("slug", "query_id"))
    heads = table(spark, d, "nodes").filter("id is not null").select("slug", F.col("id").alias("node_id"), "corpus", "data_type").distinct()
    scored = fused.join(heads, ["slug", "node_id"]).withColumn("score", F.round(ranking.penalised(F.col("score"), F.col("corpus"), F.col("node_id"), F.col("data_type")), 9))
    return ranking.top(scored, 10, ("slug", "query_id")).select("slug", "query_id", "rank", "node_id", "corpus", "score")


QUERIES = {f.__name__: f for f in (hybrid_search, classify_paths, knn_cosine, docs_entity_edges, ui_entity_edges, game_data_nodes, game_data_edges, document_sections, event_windows, expand_results, diversified_results)}

_TYPES = "CASE " + " ".join(f"WHEN regexp_matches(file_path, '{p}') THEN '{t}'" for p, t in files.PATH_TYPES) + " WHEN contains(file_path, 'Server/') THEN 'misc' END"
SQL = {
    "hybrid_search": f"""WITH {_INDEX}, {_bm25(10.0, 100, 'a')}, {_bm25(10.0, 100, 'b', 0.0)},
f AS (SELECT slug, query_id, node_id, sum(1.0::DOUBLE / (60 + rank + 1)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL), g AS (SELECT *, s / max(s) OVER (PARTITION BY slug, query_id) AS score FROM f),
h AS (SELECT DISTINCT slug, id, corpus, data_type FROM nodes WHERE id IS NOT NULL),
w AS (SELECT g.slug, query_id, node_id, corpus, round(score * CASE WHEN corpus = 'docs' AND starts_with(node_id, 'blog:') THEN 0.85::DOUBLE ELSE 1.0 END * CASE WHEN corpus = 'gamedata' AND data_type IN {ranking.WORLD_TYPES} THEN 0.5::DOUBLE ELSE 1.0 END, 9) AS score FROM g JOIN h ON h.slug = g.slug AND h.id = g.node_id)
SELECT slug, query_id, row_number() OVER (PARTITION BY slug, query_id ORDER BY score DESC, node_id) - 1 AS rank, node_id, corpus, score FROM w QUALIFY rank < 10""",
    "classify_paths": f"SELECT DISTINCT file_path, {_TYPES} AS found_type FROM nodes WHERE file_path IS NOT NULL",
    "knn_cosine": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0)
SELECT q.vec_id AS query_key, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) - 1 AS rank FROM q JOIN v ON v.vec_id <> q.vec_id QUALIFY rank < 10""",
    "docs_entity_edges": r"""WITH c AS (SELECT slug, id, unnest(list_distinct(list_concat(regexp_extract_all(coalesce(content, ''), '`([A-Za-z_][\w.#]*)(?:\(\))?`', 1), regexp_extract_all(coalesce(content, ''), '\b([A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+)\b', 1)))) AS name FROM nodes WHERE corpus = 'docs' AND id IS NOT NULL)
SELECT DISTINCT c.slug, c.id AS source_id, n.id AS target_id FROM c JOIN nodes n ON n.slug = c.slug AND n.display_name = c.name AND n.corpus IN ('code', 'gamedata') AND n.id IS NOT NULL""",
    "event_windows": "SELECT CAST(time_bucket(INTERVAL 10 MINUTES, ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
}
