"""What changed between full snapshots.

Each row of a snapshot is the ``to`` side of one comparison and the ``from``
side of the next. Both are tagged and grouped by comparison and key in a
single aggregation; only keys and 64-bit row hashes are shuffled, never
contents, and copies collapse before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.paths import normal_hash, normal_path
from lodestrata.operators.orphans import snapshot_order
from lodestrata.session import plan_bytes

BROADCAST_BYTES = 8 << 20


def comparisons(version_meta: DataFrame) -> DataFrame:
    """(slug, side, slug_from, slug_to): the part each snapshot has in comparisons of consecutive ones."""
    order = snapshot_order(version_meta)
    a, b = order.alias("a"), order.alias("b")
    pairs = a.join(b, (F.col("a.patchline").eqNullSafe(F.col("b.patchline"))) & (F.col("a.at") + 1 == F.col("b.at"))).select(F.col("a.slug").alias("slug_from"), F.col("b.slug").alias("slug_to"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("slug_from").alias("slug")), F.struct(F.lit(1).alias("side"), F.col("slug_to").alias("slug")))).alias("x")
    return pairs.select("slug_from", "slug_to", sides).select("x.slug", "x.side", "slug_from", "slug_to")


def snapshot_changes(rows: DataFrame, version_meta: DataFrame, key: Column, row_hash: Column, order: list[Column] | None = None) -> DataFrame:
    """(slug_from, slug_to, record_key, change_type) between consecutive snapshots.

    ``rows`` has a slug; ``key`` names its record, ``row_hash`` is a bigint of
    what counts as a change (nulls being equal if it isn't null for them).
    Of several rows of one slug and key the greatest by ``order`` holds, then
    the greatest hash. Null keys and unknown slugs don't count.
    """
    parts = comparisons(version_meta)
    parts = F.broadcast(parts) if plan_bytes(version_meta) <= BROADCAST_BYTES else parts
    rank = F.struct(*(order or []), row_hash.alias("h")) if order else row_hash
    tagged = rows.select("slug", key.alias("record_key"), rank.alias("rank")).filter(F.col("record_key").isNotNull()).join(parts, "slug")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("rank")))
    both = tagged.groupBy("slug_from", "slug_to", "record_key").agg(of(0).alias("old"), of(1).alias("new"))
    old, new = (F.col("old.h"), F.col("new.h")) if order else (F.col("old"), F.col("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(old != new, "changed")
    return both.select("slug_from", "slug_to", "record_key", change.alias("change_type")).filter("change_type is not null")


def node_changes(nodes: DataFrame, version_meta: DataFrame) -> DataFrame:
    """Changes of ``content`` by id; xxhash64 of null is the seed, so nulls are equal and differ from ''."""
    content = F.xxhash64(F.col("content").isNull(), F.col("content"))
    return snapshot_changes(nodes, version_meta, F.col("id"), content)


def file_changes(file_hashes: DataFrame, version_meta: DataFrame) -> DataFrame:
    """Changes of ``file_hash`` by path, both normalised; the greatest indexed_at, then batch_id, holds."""
    rows = file_hashes.select("slug", normal_path(F.col("file_path")).alias("path"), normal_hash(F.col("file_hash")).alias("hash"), "indexed_at", "batch_id").filter("path is not null and hash is not null")
    return snapshot_changes(rows, version_meta, F.col("path"), F.xxhash64("hash"), [F.col("indexed_at"), F.col("batch_id")])


def found_changes(nodes: DataFrame, file_hashes: DataFrame, version_meta: DataFrame) -> DataFrame:
    """(table_name, slug_from, slug_to, record_key, change_type) of both tables."""
    columns = ["table_name", "slug_from", "slug_to", "record_key", "change_type"]
    return node_changes(nodes, version_meta).withColumn("table_name", F.lit("nodes")).select(columns).unionByName(file_changes(file_hashes, version_meta).withColumn("table_name", F.lit("file_hashes")).select(columns))


def change_counts(changes: DataFrame) -> DataFrame:
    """Counts by table, comparison and kind."""
    return changes.groupBy("table_name", "slug_from", "slug_to", "change_type").agg(F.count(F.lit(1)).alias("n"))
