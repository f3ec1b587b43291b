"""Markdown and HTML documents as sections, with their paths, dates and references to entities."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as X

#: Words of sections that hold no content.
NOISE = ("cookie", "captcha", "subscribe", "newsletter", "are you a robot", "privacy policy", "all rights reserved")
_POST = r'href="(?:https?://[^"/]+)?(/news/\d{4}/\d{1,2}/[^"#?]+)"'


def sections(docs: DataFrame) -> DataFrame:
    """(path, place, level, title, parent, body): a document's parts at headings of level 2 and 3, what stands before them as an untitled part.

    Headings within fences don't count; ``parent`` is the last title of level 2
    above one of level 3. All by windows over the lines of a document.
    """
    lines = docs.select("path", F.posexplode(F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n")).alias("pos", "line"))
    upto = Window.partitionBy("path").orderBy("pos")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    inside = F.sum(fence.cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, -1)) % 2 == 1
    marked = lines.withColumn("head", F.when(~F.coalesce(inside, F.lit(False)) & ~fence, F.regexp_extract("line", r"^(#{2,3})\s+\S", 1)).otherwise(""))
    numbered = marked.withColumn("place", F.sum((F.col("head") != "").cast("int")).over(upto))
    parts = numbered.groupBy("path", "place").agg(F.max(F.length("head")).alias("level"), F.max(F.when(F.col("head") != "", X.trimmed(F.regexp_replace("line", r"^#{2,3}\s+|\s+#+\s*$", "")))).alias("title"), F.sort_array(F.collect_list(F.when(F.col("head") == "", F.struct("pos", "line")))).alias("ls"))
    body = X.trimmed(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    made = parts.select("path", "place", "level", "title", body.alias("body"))
    parent = F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return made.withColumn("parent", F.when(F.col("level") == 3, parent)).filter((F.col("body") != "") | F.col("title").isNotNull()).select("path", "place", "level", "title", "parent", "body")


def docs_nodes(docs: DataFrame, source: str, most: int = 8000) -> DataFrame:
    """(id, display_name, path, content, embedding_text, data_type, published_date): one node a section.

    ``docs`` has (path, content). An id is the source, the path without
    extension, the section's number and short title. The embedding text names
    title, source and parent, and is cut to ``most`` characters; content isn't.
    """
    cleaned = docs.select("path", X.strip_mdx(F.col("content")).alias("content"), X.published_date(F.col("path"), F.col("content")).alias("published_date"), X.docs_kind(F.col("path"), F.col("content")).alias("data_type"), X.frontmatter_field(F.col("content"), "title").alias("page"))
    parts = sections(cleaned.select("path", "content")).join(cleaned.drop("content"), "path")
    stem = F.regexp_replace("path", r"\.mdx?$", "")
    name = F.coalesce("title", "page", X.basename(stem))
    short = X.slug(name, fallback="section")
    text = F.concat_ws("\n", F.concat(F.lit("Docs: "), name), F.concat(F.lit(f"Source: {source}/"), F.col("path")), F.concat(F.lit("Parent: "), F.col("parent")), F.col("body"))
    return parts.select(F.concat(F.lit(f"{source}:"), stem, F.lit("#"), F.lpad(F.col("place").cast("string"), 2, "0"), F.lit("-"), short).alias("id"), name.alias("display_name"), "path", F.col("body").alias("content"), F.substring(text, 1, most).alias("embedding_text"), "data_type", "published_date")


def post_urls(page: Column) -> Column:
    """The links to posts on an index page, once each and in order."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(_POST), F.lit(1)))


def html_sections(text: str) -> list[tuple[str, str]]:
    """(title, text) of a page's parts at h2 and h3, the first as Overview; parts without content are left out."""
    body = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", text)
    pieces = re.split(r"(?is)<h[23]\b[^>]*>(.*?)</h[23]>", body)
    strip = lambda h: re.sub(r"\s+", " ", _unescape(re.sub(r"(?s)<[^>]+>", " ", h))).strip()
    found = [("Overview", strip(pieces[0])), *((strip(t), strip(b)) for t, b in zip(pieces[1::2], pieces[2::2]))]
    return [(t, b) for t, b in found if b and not any(w in f"{t} {b}".lower() for w in NOISE)]


def _unescape(text: str) -> str:
    import html

    return html.unescape(text)


def page_sections(pages: DataFrame) -> DataFrame:
    """(path, place, title, body) of HTML pages; ``pages`` has (path, content)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("place", pa.int32()), ("title", pa.string()), ("body", pa.string())])
        for batch in batches:
            rows = [{"path": p, "place": n, "title": t, "body": b} for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, (t, b) in enumerate(html_sections(c or ""))]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return pages.select("path", "content").mapInArrow(walk, "path string, place int, title string, body string")


def entity_candidates(text: Column) -> Column:
    """Identifiers in backticks and words of mixed case, once each."""
    ticked = F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][\w.#]*)(?:\(\))?`"), F.lit(1))
    pascal = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+)\b"), F.lit(1))
    return F.array_distinct(F.concat(ticked, pascal))


def docs_edges(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type): nodes that a section names, in just that spelling.

    ``docs`` has (id, content), ``targets`` (id, display_name).
    """
    named = docs.select(F.col("id").alias("source_id"), F.explode(entity_candidates(F.coalesce("content", F.lit("")))).alias("display_name"))
    return named.join(targets.select(F.col("id").alias("target_id"), "display_name"), "display_name").select("source_id", "target_id", F.lit("DOCS_REFERENCES").alias("edge_type")).distinct()
