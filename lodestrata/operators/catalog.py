"""Versions, upserts, change sets, counts: the bookkeeping of an index as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.paths import normal_hash, normal_path

#: Which source of docs goes first when two have the same text.
SOURCE_ORDER = ("repo", "modding", "support", "blog", "re", "local")


def newest_first() -> list[Column]:
    return [F.col("version_date").desc_nulls_last(), F.col("indexed_at").desc_nulls_last(), F.col("build_number").desc_nulls_last(), F.col("slug").desc()]


def latest_versions(version_meta: DataFrame) -> DataFrame:
    """The newest version of each patchline: by date, then time of indexing, then build number, then slug."""
    by = Window.partitionBy("patchline").orderBy(*newest_first())
    return version_meta.dropDuplicates(["slug"]).withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")


def prune_candidates(version_meta: DataFrame, keep: int) -> DataFrame:
    """(patchline, slug, age): versions beyond the ``keep`` newest of their patchline; none if keep is 0 or less."""
    by = Window.partitionBy("patchline").orderBy(*newest_first())
    aged = version_meta.dropDuplicates(["slug"]).withColumn("age", F.row_number().over(by))
    return aged.filter(F.lit(keep > 0) & (F.col("age") > keep)).select("patchline", "slug", "age")


def resolve_versions(version_meta: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, slug): a reference may be a slug, its part after the patchline, a build number with or without b, a hash or a date; the newest match holds, none gives null."""
    v = version_meta.dropDuplicates(["slug"])
    build = F.col("build_number").cast("string")
    tail = F.regexp_extract("slug", r"_(b\d+_.*)$", 1)
    names = v.select(*v.columns, F.explode(F.array(F.col("slug"), tail, F.concat(F.lit("b"), build), build, F.col("short_hash"), F.col("version_date"))).alias("ref"))
    by = Window.partitionBy("ref").orderBy(*newest_first())
    best = names.withColumn("n", F.row_number().over(by)).filter("n = 1").select("ref", "slug")
    return refs.select("ref").distinct().join(best, "ref", "left")


def upsert(existing: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``delta`` in place of the rows of ``existing`` that it has the keys of."""
    return existing.join(delta.select(*keys).distinct(), keys, "left_anti").unionByName(delta)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the first by ``order``."""
    by = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def delete_by_key(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def numbered_ids(rows: DataFrame, key: str, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """Repeated ids told apart: the second becomes ``id~2`` and so on, in ``order``."""
    by = Window.partitionBy(*(partition or []), key).orderBy(*order)
    n = F.row_number().over(by)
    return rows.withColumn(key, F.when(n > 1, F.concat(key, F.lit("~"), n.cast("string"))).otherwise(F.col(key)))


def change_set(current: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, status): ADDED, CHANGED, UNCHANGED or DELETED; both sides have one row a key."""
    a = current.select(*keys, F.col(value).alias("__now"), F.lit(True).alias("__a"))
    b = stored.select(*keys, F.col(value).alias("__old"), F.lit(True).alias("__b"))
    status = F.when(F.col("__b").isNull(), "ADDED").when(F.col("__a").isNull(), "DELETED").when(F.col("__now").eqNullSafe(F.col("__old")), "UNCHANGED").otherwise("CHANGED")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def may_skip(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, skip): nothing changed and something is unchanged; an empty source isn't skipped."""
    count = lambda s: F.count(F.when(F.col("status").isin(*s), 1))
    return changes.groupBy(*keys).agg(((count(["ADDED", "CHANGED", "DELETED"]) == 0) & (count(["UNCHANGED"]) > 0)).alias("skip"), count(["ADDED", "CHANGED"]).alias("n_changed"))


def current_files(file_hashes: DataFrame) -> DataFrame:
    """(slug, corpus_type, file_path, file_hash): each file's last state, paths and hashes in normal form."""
    rows = file_hashes.select("slug", "corpus_type", normal_path(F.col("file_path")).alias("file_path"), normal_hash(F.col("file_hash")).alias("file_hash"), "indexed_at", "batch_id").filter("file_path is not null and file_hash is not null")
    return rows.groupBy("slug", "corpus_type", "file_path").agg(F.max(F.struct("indexed_at", "batch_id", "file_hash")).alias("r")).select("slug", "corpus_type", "file_path", "r.file_hash")


def stats_nodes(nodes: DataFrame) -> DataFrame:
    """(slug, corpus, kind, n): nodes of each type, data_type before node_type."""
    return nodes.filter("id is not null").select("slug", "id", "corpus", F.coalesce("data_type", "node_type").alias("kind")).distinct().groupBy("slug", "corpus", "kind").agg(F.count(F.lit(1)).alias("n"))


def stats_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(slug, corpus, edge_type, n): edges by the corpus of their source."""
    heads = nodes.filter("id is not null").select("slug", F.col("id").alias("source_id"), "corpus").distinct()
    return edges.select("slug", "id", "source_id", "edge_type").distinct().join(heads, ["slug", "source_id"]).groupBy("slug", "corpus", "edge_type").agg(F.count(F.lit(1)).alias("n"))


def cache_lookup(texts: DataFrame, cache: DataFrame, text: str, model: str) -> DataFrame:
    """(content_hash, hit): each distinct text's SHA-256 and whether the cache has it for the model."""
    wanted = texts.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("content_hash")).distinct()
    have = cache.filter((F.col("model_id") == model) & F.col("vector").isNotNull()).select("content_hash", F.lit(True).alias("hit")).distinct()
    return wanted.join(have, "content_hash", "left").select("content_hash", F.coalesce("hit", F.lit(False)).alias("hit"))


def source_priority(documents: DataFrame) -> DataFrame:
    """(doc_id, source, content_hash): of equal texts the one whose source goes first, then the least id; null texts are left out."""
    rank = F.coalesce(*(F.when(F.col("source") == s, n) for n, s in enumerate(SOURCE_ORDER)), F.lit(len(SOURCE_ORDER)))
    rows = documents.filter("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"), rank.alias("place"))
    return rows.groupBy("content_hash").agg(F.min(F.struct("place", "doc_id", "source")).alias("r")).select("r.doc_id", "r.source", "content_hash")


def glob_members(includes: DataFrame, names: DataFrame) -> DataFrame:
    """(group_id, name): names that an include glob of the group matches and no exclude glob.

    ``includes`` has (group_id, glob, exclude); it is a table of rules, which
    is matched in one pass over the names. Globs without * are joined by
    equality, so only real patterns are tried on each name.
    """
    from lodestrata.functions.text import glob_pattern

    plain = includes.filter(F.instr("glob", "*") == 0).join(names.select(F.col("name").alias("glob"), "name").distinct(), "glob").select("group_id", "name", "exclude")
    wild = includes.filter(F.instr("glob", "*") > 0).withColumn("pattern", glob_pattern(F.col("glob")))
    # the fixed text before the first * is an equality on a prefix of its length; there are as many lengths as the longest glob has characters, at most
    prefix = F.substring_index("glob", "*", 1)
    keyed = wild.withColumns({"prefix": prefix, "width": F.length(prefix)})
    widths = [r["width"] for r in keyed.select("width").distinct().collect()]
    by_width = names.select("name", F.explode(F.array(*(F.lit(w) for w in widths)) if widths else F.array().cast("array<int>")).alias("width")).withColumn("prefix", F.expr("substring(name, 1, width)"))
    hits = by_width.join(keyed, ["prefix", "width"]).filter(F.expr("name rlike pattern")).select("group_id", "name", "exclude")
    return plain.unionByName(hits).groupBy("group_id", "name").agg(F.max(F.col("exclude").cast("int")).alias("out")).filter("out = 0").select("group_id", "name")


def stem_targets(stems: DataFrame, nodes: DataFrame) -> DataFrame:
    """(slug, stem, node_id, multi_match): nodes whose name is the stem, without case; several are all given and flagged.

    ``stems`` has (slug, stem).
    """
    heads = nodes.filter("id is not null and display_name is not null").select("slug", F.col("id").alias("node_id"), F.lower("display_name").alias("key")).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("slug", "stem"))
    hits = stems.select("slug", "stem", F.lower("stem").alias("key")).distinct().join(heads, ["slug", "key"])
    return hits.select("slug", "stem", "node_id", (n > 1).alias("multi_match"))
