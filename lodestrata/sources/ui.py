"""Client UI files as nodes, and what they bind to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import basename

#: Folders without content, and words that name controls rather than things.
SKIPPED = ("fonts", "theme", "language", "licenses")
CONTROLS = ("button", "panel", "label", "image", "text", "group", "list", "grid", "slot", "icon", "title", "header", "footer", "container", "window", "screen", "view", "menu", "tab", "item", "row", "column", "style", "color", "width", "height", "anchor", "margin", "padding")
KINDS = {"xaml": "xaml", "ui": "ui", "json": "config"}


def ui_nodes(files: DataFrame) -> DataFrame:
    """(id, node_type, display_name, path, category, content, embedding_text) of .xaml, .ui and .json files; blank ones are left out."""
    low = F.lower("path")
    ext = F.regexp_extract(low, r"\.([a-z]+)$", 1)
    kept = files.filter(ext.isin(*KINDS) & ~low.rlike(rf"(^|/)({'|'.join(SKIPPED)})/") & (F.trim(F.regexp_replace("content", r"\s+", " ")) != ""))
    kind = F.coalesce(*(F.when(ext == e, k) for e, k in KINDS.items()))
    name = F.regexp_replace(basename(F.col("path")), r"\.[^.]*$", "")
    category = F.substring_index("path", "/", 1)
    text = F.concat_ws("\n", F.concat(F.lit("UI: "), name), F.concat(F.lit("Category: "), category), F.concat(F.lit("Purpose: "), purpose(name)), F.concat(F.lit("File: "), F.col("path")))
    return kept.select(F.concat(kind, F.lit(":"), "path").alias("id"), kind.alias("node_type"), name.alias("display_name"), "path", category.alias("category"), "content", text.alias("embedding_text"))


def purpose(name: Column) -> Column:
    """A file's name as words."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.]+", " ")))


def ui_candidates(nodes: DataFrame) -> DataFrame:
    """(source_id, key, confidence): names in a UI file that may be those of records: stems of resource paths .8, values of id-like keys .6, mixed-case words .5, the file's name .4."""
    of = lambda pattern, confidence: F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lower(t).alias("key"), F.lit(confidence).alias("confidence")))
    stem = F.regexp_replace("display_name", r"(?i)(screen|panel|window|hud|page|view)$", "")
    all_ = F.concat(of(r"""["'][\w/.-]*/([A-Za-z][\w-]*)\.[a-z]{2,5}["']""", 0.8), of(r"""(?i)["']?\b(?:id|itemid|name|type|target)["']?\s*[:=]\s*["']([A-Za-z][\w-]*)["']""", 0.6), of(r"\b([A-Z][a-z0-9]+(?:_?[A-Z][a-z0-9]+)+)\b", 0.5), F.array(F.struct(F.lower(stem).alias("key"), F.lit(0.4).alias("confidence"))))
    return nodes.select(F.col("id").alias("source_id"), F.posexplode(all_).alias("seq", "x")).select("source_id", "seq", "x.key", "x.confidence").filter((F.length("key") > 2) & ~F.col("key").isin(*CONTROLS))


def ui_edges(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type, confidence): each binding once, at its greatest confidence, the first of equals.

    ``targets`` has (id, display_name); names are compared without case.
    """
    hits = ui_candidates(nodes).join(targets.select(F.col("id").alias("target_id"), F.lower("display_name").alias("key")), "key")
    by = Window.partitionBy("source_id", "target_id").orderBy(F.desc("confidence"), "seq")
    return hits.withColumn("n", F.row_number().over(by)).filter("n = 1").select("source_id", "target_id", F.lit("UI_BINDS_TO").alias("edge_type"), "confidence")
