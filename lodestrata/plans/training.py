"""The core's queries on training-data problems, each over its whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators import incremental, orphans, records, snapshots
from lodestrata.session import staged, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return records.found_records(table(spark, d, "nodes"))


def p2_variants(spark: SparkSession, d: str) -> DataFrame:
    return records.variant_catalog(records.array_records(table(spark, d, "nodes").select("slug", "id", "corpus", "content", "metadata").dropDuplicates()))


def p2_subtypes(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").select("slug", "id", "corpus", "content", "metadata").dropDuplicates()
    return records.subtype_catalog(staged(records.array_records(nodes, with_record=True).select("field_name", "path", "variant", "record")))


def p2_typed(spark: SparkSession, d: str) -> DataFrame:
    return records.typed_records(table(spark, d, "nodes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.found_deltas(table(spark, d, "file_hashes"), table(spark, d, "index_runs"), table(spark, d, "version_meta"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.found_orphans(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "version_meta"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "version_meta"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.found_changes(table(spark, d, "nodes"), table(spark, d, "file_hashes"), table(spark, d, "version_meta"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p6_found(spark, d))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_variants, p2_subtypes, p2_typed, p3_found, p4_found, p4_counts, p6_found, p6_counts)}

_ORDER = """snap AS (SELECT slug, patchline, row_number() OVER (PARTITION BY patchline ORDER BY version_date, build_number, slug) AS place FROM version_meta)"""
_PATH = r"nullif(regexp_replace(replace(file_path, '\', '/'), '^(?:\./)+', ''), '')"
_HASH = "nullif(lower(file_hash), '')"

_REFS = f"""{_ORDER},
refs AS (SELECT id AS edge_id, slug, 'source' AS ref_side, source_id AS ref FROM edges UNION ALL SELECT id, slug, 'target', target_id FROM edges),
real_refs AS (SELECT r.*, s.patchline, s.place FROM refs r JOIN snap s USING (slug) WHERE ref IS NOT NULL AND ref <> '' AND NOT starts_with(ref, 'virtual:')),
have AS (SELECT DISTINCT n.id, s.patchline, s.place FROM nodes n JOIN snap s USING (slug) WHERE n.id IS NOT NULL),
span AS (SELECT id, patchline, min(place) AS first_at, max(place) AS last_at FROM have GROUP BY ALL),
orphan AS (SELECT r.*, CASE WHEN first_at < r.place THEN 'deleted' WHEN last_at > r.place THEN 'later' ELSE 'missing' END AS orphan_kind
  FROM real_refs r LEFT JOIN span p ON p.id = r.ref AND p.patchline = r.patchline
  WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.id = r.ref AND h.patchline = r.patchline AND h.place = r.place))"""

_CHANGES = f"""{_ORDER},
pairs AS (SELECT a.slug AS slug_from, b.slug AS slug_to FROM snap a JOIN snap b ON a.patchline = b.patchline AND a.place + 1 = b.place),
state AS (
  SELECT DISTINCT 'nodes' AS table_name, slug, id AS record_key, coalesce('v' || content, 'n') AS v FROM nodes WHERE id IS NOT NULL
  UNION ALL
  SELECT 'file_hashes', slug, path, arg_max(hash, (indexed_at, batch_id)) FROM (SELECT slug, {_PATH} AS path, {_HASH} AS hash, indexed_at, batch_id FROM file_hashes) WHERE path IS NOT NULL AND hash IS NOT NULL GROUP BY ALL),
changes AS (
  SELECT coalesce(o.table_name, n.table_name) AS table_name, coalesce(o.slug_from, n.slug_from) AS slug_from, coalesce(o.slug_to, n.slug_to) AS slug_to, coalesce(o.record_key, n.record_key) AS record_key,
    CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS change_type
  FROM (SELECT * FROM state JOIN pairs ON slug = slug_from) o FULL JOIN (SELECT * FROM state JOIN pairs ON slug = slug_to) n
    ON o.table_name = n.table_name AND o.slug_from = n.slug_from AND o.slug_to = n.slug_to AND o.record_key = n.record_key
  WHERE o.v IS DISTINCT FROM n.v)"""

SQL: dict[str, str] = {
    "p3_found": f"""
WITH good AS (SELECT DISTINCT run_id, patchline, corpus_type, through_batch FROM index_runs WHERE lower(run_status) = 'success'),
runs AS (SELECT *, lag(through_batch) OVER (PARTITION BY patchline, corpus_type ORDER BY run_id) AS from_batch FROM good),
ledger AS (SELECT v.patchline, f.corpus_type, {_PATH} AS path, {_HASH} AS hash, f.indexed_at, batch_id FROM file_hashes f JOIN version_meta v USING (slug)),
usable AS (SELECT * FROM ledger WHERE path IS NOT NULL AND hash IS NOT NULL),
now AS (SELECT run_id, path, arg_max(hash, (indexed_at, batch_id)) AS h FROM runs r JOIN usable u ON u.patchline = r.patchline AND u.corpus_type = r.corpus_type AND u.batch_id <= r.through_batch GROUP BY ALL),
old AS (SELECT run_id, path, arg_max(hash, (indexed_at, batch_id)) AS h FROM runs r JOIN usable u ON u.patchline = r.patchline AND u.corpus_type = r.corpus_type AND u.batch_id <= r.from_batch GROUP BY ALL)
SELECT now.run_id, now.path AS file_path FROM now LEFT JOIN old ON old.run_id = now.run_id AND old.path = now.path WHERE now.h IS DISTINCT FROM old.h""",
    "p4_found": f"WITH {_REFS} SELECT DISTINCT edge_id, ref_side, orphan_kind FROM orphan",
    "p4_counts": f"WITH {_REFS} SELECT 'edges' AS table_name, slug, ref_side, orphan_kind, count(DISTINCT ref) AS n_keys, CAST(count(*) AS BIGINT) AS n_refs FROM orphan GROUP BY ALL",
    "p6_found": f"WITH {_CHANGES} SELECT table_name, slug_from, slug_to, record_key, change_type FROM changes",
    "p6_counts": f"WITH {_CHANGES} SELECT table_name, slug_from, slug_to, change_type, count(*) AS n FROM changes GROUP BY ALL",
}
