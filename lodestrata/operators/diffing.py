"""Differences of two versions of an index: entries, details, significance, cross references, patch notes."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import signature, significance
from lodestrata.operators.graph import unique_edges
from lodestrata.session import spread, staged

ORDER = ("ADDED", "REMOVED", "CHANGED")
#: Characters of names that go to the texts at once.
NAME_CHARS = 1 << 20


def node_states(nodes: DataFrame, slug: str | Column) -> DataFrame:
    """(id, corpus, data_type, node_type, display_name, file_path, content, published_date, content_hash) of one version, each node once."""
    rows = nodes.filter((F.col("slug") == slug) & F.col("id").isNotNull()).select("id", "corpus", "data_type", "node_type", "display_name", "file_path", "content", "published_date")
    return rows.dropDuplicates(["id"]).withColumn("content_hash", F.xxhash64(F.col("content").isNull(), "content"))


def version_diff(old: DataFrame, new: DataFrame, corpus: str | None = None, change: str | None = None, data_type: str | None = None, scope: str | None = None) -> DataFrame:
    """(id, change, corpus, data_type, display_name, significance, detail, place): what differs between two versions.

    Corpora that only one side has are left out (see ``skipped_corpora``).
    detail tells for code whether the signature or the body changed, for docs
    which of body, title and date; ``place`` is the order ADDED, REMOVED,
    CHANGED, then id. Summaries are counted without filters.
    """
    both = old.select("corpus").distinct().join(new.select("corpus").distinct(), "corpus", "left_semi")
    a, b = old.join(both, "corpus", "left_semi").alias("a"), new.join(both, "corpus", "left_semi").alias("b")
    pairs = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    kind = F.when(F.col("a.id").isNull(), "ADDED").when(F.col("b.id").isNull(), "REMOVED").when(F.col("a.content_hash") != F.col("b.content_hash"), "CHANGED")
    titled = F.when((F.col("b.corpus") == "docs") & (~F.col("a.display_name").eqNullSafe(F.col("b.display_name")) | ~F.col("a.published_date").eqNullSafe(F.col("b.published_date"))), "CHANGED")
    change_type = F.coalesce(kind, titled)
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
    parts = F.concat_ws(",", F.when(~F.col("a.content").eqNullSafe(F.col("b.content")), "body"), F.when(~F.col("a.display_name").eqNullSafe(F.col("b.display_name")), "title"), F.when(~F.col("a.published_date").eqNullSafe(F.col("b.published_date")), "date"))
    code = F.when(signature(F.col("a.content")) != signature(F.col("b.content")), "signature").otherwise("body")
    detail = F.when(change_type != "CHANGED", F.lit(None)).when(pick("corpus") == "code", code).when(pick("corpus") == "docs", parts).when(pick("corpus") == "gamedata", "fields").otherwise("content")
    out = pairs.select(pick("id").alias("id"), change_type.alias("change"), pick("corpus").alias("corpus"), pick("data_type").alias("data_type"), pick("display_name").alias("display_name"), pick("file_path").alias("file_path"), detail.alias("detail")).filter("change is not null")
    for column, value in (("corpus", corpus), ("change", change), ("data_type", data_type)):
        out = out if value is None else out.filter(F.col(column) == value)
    if scope:
        part = "%" + scope.replace("\\", "\\\\") + "%"
        out = out.filter(F.col("display_name").ilike(part) | F.col("id").ilike(part) | F.col("file_path").ilike(part))
    place = F.coalesce(*(F.when(F.col("change") == c, n) for n, c in enumerate(ORDER)))
    return out.select("id", "change", "corpus", "data_type", "display_name", significance(F.col("id"), F.col("corpus"), F.col("data_type"), F.col("change")).alias("significance"), "detail", place.alias("place"))


def skipped_corpora(old: DataFrame, new: DataFrame) -> DataFrame:
    """(corpus, side): corpora of one side only."""
    a, b = old.select("corpus").distinct(), new.select("corpus").distinct()
    return a.join(b, "corpus", "left_anti").withColumn("side", F.lit("old")).unionByName(b.join(a, "corpus", "left_anti").withColumn("side", F.lit("new")))


def summary(diff: DataFrame) -> DataFrame:
    """(corpus, added, removed, changed)."""
    count = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c.lower())
    return diff.groupBy("corpus").agg(*(count(c) for c in ORDER))


def cross_references(diff: DataFrame, edges: DataFrame, per_node: int = 5) -> DataFrame:
    """(id, other_id, edge_type, rank): up to five other ends of the edges of gamedata that was added or changed.

    ``edges`` are those of the new version.
    """
    changed = diff.filter((F.col("corpus") == "gamedata") & F.col("change").isin("ADDED", "CHANGED")).select("id")
    kept = unique_edges(edges)
    ends = kept.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other_id")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other_id")))).alias("x"), "edge_type", "seq").select("x.id", "x.other_id", "edge_type", "seq")
    by = Window.partitionBy("id").orderBy("seq", "other_id", "edge_type")
    return ends.join(changed, "id", "left_semi").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= per_node).select("id", "other_id", "edge_type", "rank")


def patch_notes(diff: DataFrame, docs: DataFrame, per_name: int = 3, least: int = 4, block_chars: int = NAME_CHARS) -> DataFrame:
    """(name, doc_id, rank): documents whose text or title has the name of what changed much, anywhere and without case.

    Names of ``least`` characters or more. ``docs`` has (doc_id, text) and may
    have title. The names go to the texts in blocks of about ``block_chars``
    characters, a pass over the texts each; texts are never shuffled.
    """
    names = staged(diff.filter((F.col("significance") == "HIGH") & (F.length("display_name") >= least)).select(F.lower("display_name").alias("name")).distinct())
    blocks = max(1, -(-(names.agg(F.sum(F.length("name"))).collect()[0][0] or 0) // block_chars))
    texts = spread(docs.select("doc_id", *(F.lower(c).alias(c) for c in ("text", "title") if c in docs.columns)))
    parts = []
    for block in range(blocks):
        some = [r["name"] for r in (names if blocks == 1 else names.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block)).collect()]
        found = _mentions(texts, some).distinct()
        parts.append(found if blocks == 1 else staged(found))
    by = Window.partitionBy("name").orderBy("doc_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= per_name)


def _mentions(texts: DataFrame, names: list[str]) -> DataFrame:
    """(name, doc_id) of each of ``names`` that is a substring of any text of a row.

    A name is looked for where its gram is, the run of up to 4 characters that
    the fewest names share; a text that has the name has its gram.
    """
    width = min([4, *map(len, names)])
    grams = lambda text: {text[i : i + width] for i in range(len(text) - width + 1)}
    shared = Counter(g for name in names for g in grams(name))
    under: dict[str, list[str]] = defaultdict(list)
    for name in names:
        under[min(grams(name), key=lambda g: (shared[g], g))].append(name)
    keys, under = frozenset(under), dict(under)
    schema = T.StructType([T.StructField("name", T.StringType()), texts.schema["doc_id"]])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, found = [], []
            for n, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                row = [text for text in row if text is not None]
                for gram in set().union(*(keys & grams(text) for text in row)):
                    hits = [name for name in under[gram] if any(name in text for text in row)]
                    take += [n] * len(hits)
                    found += hits
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0).take(pa.array(take, pa.int64()))], ["name", "doc_id"])

    return texts.mapInArrow(find, schema)


def flatten_json(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, path, value): the leaves of JSON objects by dotted path, places of arrays as numbers; what is no JSON object has no leaves.

    Leaves are compared as JSON texts; empty objects and arrays are leaves.
    """
    from lodestrata.operators.records import leaves_of, parse_object

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, paths, values = [], [], []
            for n, t in enumerate(batch.column(len(keys)).to_pylist()):
                root = parse_object(t)
                for p, v in leaves_of(root) if root is not None else ():
                    take.append(n)
                    paths.append(p)
                    values.append(v)
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in range(len(keys))), pa.array(paths, pa.string()), pa.array(values, pa.string())], [f.name for f in schema])

    return rows.select(*keys, text).mapInArrow(walk, schema)


def field_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, change, old_value, new_value) of two outputs of ``flatten_json``, of keys that both have."""
    common = old.select(*keys).distinct().join(new.select(*keys).distinct(), keys, "left_semi")
    a = old.join(common, keys, "left_semi").select(*keys, "path", F.col("value").alias("old_value"), F.lit(1).alias("__a"))
    b = new.join(common, keys, "left_semi").select(*keys, "path", F.col("value").alias("new_value"), F.lit(1).alias("__b"))
    kind = F.when(F.col("__a").isNull(), "ADDED").when(F.col("__b").isNull(), "REMOVED").when(F.col("old_value") != F.col("new_value"), "CHANGED")
    return a.join(b, [*keys, "path"], "full_outer").withColumn("change", kind).filter("change is not null").select(*keys, "path", "change", "old_value", "new_value")
