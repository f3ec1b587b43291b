"""The subpackage's queries, each over its whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import markup, packing, repetition, splitting, tokens, vptree
from lodestrata.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vptree.found_pairs(table(spark, d, "embedding_cache"))


def p1_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = vptree.usable(table(spark, d, "embedding_cache")).distinct()
    return vptree.most_similar(rows, vptree.similar_queries(rows))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found_markup(table(spark, d, "nodes"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_nodes(table(spark, d, "nodes")).select("slug", "node_id", "field_name", F.concat_ws(",", "kinds").alias("kinds"), "clean_text").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found_split(table(spark, d, "nodes"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.all_pieces(table(spark, d, "nodes"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(p9_packing(spark, d)).agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_unused").alias("n_unused"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.found_repetitive(table(spark, d, "documents"))


def p10_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_topk, p5_found, p5_clean, p7_found, p7_pieces, p8_ids, p9_packing, p9_fill, p10_found, p10_repetition)}
SQL: dict[str, str] = {
    "p1_found": """
WITH v AS (SELECT DISTINCT model_id, dimension, content_hash, list_transform(vector, lambda x: x::DOUBLE) AS e FROM embedding_cache
  WHERE content_hash IS NOT NULL AND model_id IS NOT NULL AND vector IS NOT NULL AND len(vector) = dimension AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)
SELECT DISTINCT a.model_id, a.content_hash AS hash_a, b.content_hash AS hash_b FROM v a JOIN v b ON a.model_id = b.model_id AND a.dimension = b.dimension AND a.content_hash < b.content_hash WHERE list_cosine_similarity(a.e, b.e) >= 0.92""",
    "p10_found": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(words) AS n, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
h AS (SELECT doc_id, n, i, array_to_string(words[i : i + 7], ' ') AS gram FROM g),
again AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS nth FROM h),
covered AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + 8)) AS at_word FROM again WHERE nth > 1)
SELECT doc_id FROM covered GROUP BY doc_id, n HAVING count(*) >= 0.4 * n""",
    "p7_found": """
SELECT DISTINCT slug, id AS node_id, CASE WHEN list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) > 2000 THEN 'inside_line' ELSE 'line' END AS cut_kind
FROM nodes WHERE length(content) > 2000""",
}
