"""References to records that don't exist.

Parent and child keys are brought into one tagged long form and grouped by
parent table and key; a group without a parent flag in the child's period is
an orphan key, with its number of references. The heavy work is on keys, not
on references: copies of a key collapse before the shuffle, so a target that
holds a third of all references is one row by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import plan_bytes

BROADCAST_BYTES = 8 << 20


def snapshot_order(version_meta: DataFrame) -> DataFrame:
    """(slug, patchline, at): the place of each snapshot in its patchline, by date, then build number, then slug."""
    by = Window.partitionBy("patchline").orderBy("version_date", "build_number", "slug")
    return version_meta.select("slug", "patchline", "version_date", "build_number").filter("slug is not null").dropDuplicates(["slug"]).select("slug", "patchline", F.row_number().over(by).alias("at"))


def _small(df: DataFrame, of: DataFrame) -> DataFrame:
    return F.broadcast(df) if plan_bytes(of) <= BROADCAST_BYTES else df


def is_reference(ref: Column) -> Column:
    """Not null, not empty and not virtual, which has no record by design."""
    return ref.isNotNull() & (ref != "") & ~ref.startswith("virtual:")


def orphan_keys(edges: DataFrame, nodes: DataFrame, version_meta: DataFrame) -> DataFrame:
    """(slug, ref_side, ref, n_refs, orphan_kind): each referred key that its snapshot's nodes lack.

    orphan_kind is ``deleted`` if an earlier snapshot of the patchline has the
    key, else ``later`` if a later one has it, else ``missing``. n_refs counts
    edge rows. A slug that version_meta lacks is a patchline of its own. Keys
    are compared character for character.
    """
    order = snapshot_order(version_meta)
    sides = F.explode(F.array(F.struct(F.lit("source").alias("ref_side"), F.col("source_id").alias("ref")), F.struct(F.lit("target").alias("ref_side"), F.col("target_id").alias("ref")))).alias("r")
    children = edges.select("slug", sides).select("slug", "r.ref_side", "r.ref").filter(is_reference(F.col("ref")))
    long = children.select("slug", "ref", "ref_side").unionByName(nodes.filter("id is not null").select("slug", F.col("id").alias("ref"), F.lit(None).cast("string").alias("ref_side")))
    long = long.join(_small(order, version_meta), "slug", "left").withColumns({"patchline": F.coalesce("patchline", F.concat(F.lit("slug:"), "slug")), "at": F.coalesce("at", F.lit(1))})
    counted = long.groupBy("patchline", "ref", "at", "slug").agg(F.count(F.when(F.col("ref_side") == "source", 1)).alias("n_source"), F.count(F.when(F.col("ref_side") == "target", 1)).alias("n_target"), F.count(F.when(F.col("ref_side").isNull(), 1)).alias("n_parent"))
    of_key = Window.partitionBy("patchline", "ref")
    had = F.when(F.col("n_parent") > 0, F.col("at"))
    flagged = counted.withColumns({"first_at": F.min(had).over(of_key), "last_at": F.max(had).over(of_key)})
    orphans = flagged.filter((F.col("n_parent") == 0) & (F.col("n_source") + F.col("n_target") > 0))
    kind = F.when(F.col("first_at") < F.col("at"), "deleted").when(F.col("last_at") > F.col("at"), "later").otherwise("missing")
    per_side = F.explode(F.array(F.struct(F.lit("source").alias("ref_side"), F.col("n_source").alias("n_refs")), F.struct(F.lit("target").alias("ref_side"), F.col("n_target").alias("n_refs")))).alias("x")
    return orphans.select("slug", "ref", kind.alias("orphan_kind"), per_side).select("slug", "x.ref_side", "ref", "x.n_refs", "orphan_kind").filter("n_refs > 0")


def orphan_counts(edges: DataFrame, nodes: DataFrame, version_meta: DataFrame) -> DataFrame:
    """(table_name, slug, ref_side, orphan_kind, n_keys, n_refs): the report per table and period."""
    return orphan_keys(edges, nodes, version_meta).groupBy("slug", "ref_side", "orphan_kind").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_refs").alias("n_refs")).select(F.lit("edges").alias("table_name"), "slug", "ref_side", "orphan_kind", "n_keys", "n_refs")


def found_orphans(edges: DataFrame, nodes: DataFrame, version_meta: DataFrame) -> DataFrame:
    """Distinct (edge_id, ref_side, orphan_kind): each reference that leads nowhere.

    The references are joined with the orphan keys. If those are few, adaptive
    execution broadcasts them by their measured size; else it splits the
    partition of a key that holds a great share of the references. The final
    grouping is by edge, which no key can make uneven.
    """
    keys = orphan_keys(edges, nodes, version_meta)
    sides = F.explode(F.array(F.struct(F.lit("source").alias("ref_side"), F.col("source_id").alias("ref")), F.struct(F.lit("target").alias("ref_side"), F.col("target_id").alias("ref")))).alias("r")
    refs = edges.select(F.col("id").alias("edge_id"), "slug", sides).select("edge_id", "slug", "r.ref_side", "r.ref").filter(is_reference(F.col("ref")))
    return refs.join(keys.select("slug", "ref_side", "ref", "orphan_kind"), ["slug", "ref_side", "ref"]).select("edge_id", "ref_side", "orphan_kind").distinct()
