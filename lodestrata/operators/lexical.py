"""Full-text index and BM25 over nodes, and literal or regex search of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import query_terms, split_identifiers, tokens
from lodestrata.session import plan_bytes

K1, B = 1.2, 0.75
BROADCAST_BYTES = 16 << 20


def index_rows(nodes: DataFrame) -> DataFrame:
    """(slug, node_id, corpus, name, body): what is indexed, each node once.

    Code has the words of its identifiers added, as search for a part of a
    camel-case name should find it; other corpora are taken as they are.
    """
    rows = nodes.filter("id is not null").select("slug", F.col("id").alias("node_id"), "corpus", F.coalesce("display_name", F.lit("")).alias("name"), F.coalesce("content", F.lit("")).alias("body"))
    code = F.col("corpus") == "code"
    return rows.withColumns({"name": F.when(code, split_identifiers(F.col("name"))).otherwise(F.col("name")), "body": F.when(code, split_identifiers(F.col("body"))).otherwise(F.col("body"))})


def build_index(nodes: DataFrame) -> DataFrame:
    """(slug, node_id, corpus, name_tokens, body_tokens, dl); copies of a node count once."""
    rows = index_rows(nodes.filter("id is not null").select("slug", "id", "corpus", "display_name", "content").dropDuplicates(["slug", "id"]))
    made = rows.select("slug", "node_id", "corpus", tokens(F.col("name")).alias("name_tokens"), tokens(F.col("body")).alias("body_tokens"))
    return made.withColumn("dl", F.size("name_tokens") + F.size("body_tokens"))


def _long(index: DataFrame) -> DataFrame:
    """(slug, node_id, corpus, dl, term, in_name), a row for each token."""
    of = lambda column, flag: index.select("slug", "node_id", "corpus", "dl", F.explode(column).alias("term"), F.lit(flag).alias("in_name"))
    return of("name_tokens", 1).unionAll(of("body_tokens", 0))


def _count(long: DataFrame) -> DataFrame:
    return long.groupBy("slug", "term", "node_id", "corpus", "dl").agg(F.sum("in_name").alias("tf_name"), F.sum(1 - F.col("in_name")).alias("tf_body"))


def postings(index: DataFrame) -> DataFrame:
    """(slug, term, node_id, corpus, dl, tf_name, tf_body): the inverted index, to be written partitioned by slug and reused."""
    return _count(_long(index))


def bm25(index: DataFrame, queries: DataFrame, corpus: str | None = None, limit: int = 100, name_weight: float = 10.0, body_weight: float = 1.0, round_to: int | None = None) -> DataFrame:
    """(slug, query_id, node_id, score, rank): the best of each query in each snapshot.

    Terms of a query count as often as they stand in it. Number of documents,
    document frequencies and mean length are those of the whole snapshot; the
    corpus is a filter afterwards. Only tokens that some query asks for are
    counted and shuffled. An idf of 0 or less is taken as 1e-6. Scores are
    positive, more being better.
    """
    asked = queries.select("query_id", F.explode(F.transform(query_terms(F.col("query")), F.lower)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = asked.select("term").distinct()
    wanted = F.broadcast(wanted) if plan_bytes(queries) <= BROADCAST_BYTES else wanted
    stats = index.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    found = _count(_long(index).join(wanted, "term"))
    df = found.groupBy("slug", "term").agg(F.count(F.lit(1)).alias("n_t"))
    scored = found.join(asked, "term").join(df, ["slug", "term"]).join(stats, "slug")
    ratio = F.log((F.col("n") - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5))
    idf = F.when(ratio <= 0, F.lit(1e-6)).otherwise(ratio)
    f = name_weight * F.col("tf_name") + body_weight * F.col("tf_body")
    part = F.col("times") * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    total = scored.filter(F.lit(True) if corpus is None else F.col("corpus") == corpus).groupBy("slug", "query_id", "node_id").agg(F.sum(part).alias("score"))
    score = F.col("score") if round_to is None else F.round("score", round_to)
    by = Window.partitionBy("slug", "query_id").orderBy(F.desc("score"), "node_id")
    return total.withColumn("score", score).withColumn("rank", F.row_number().over(by) - 1).filter(F.col("rank") < limit)


def match_all(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(slug, query_id, node_id): nodes that have all of a query's terms, in name or body."""
    asked = queries.select("query_id", F.array_distinct(F.transform(query_terms(F.col("query")), F.lower)).alias("terms")).filter(F.size("terms") > 0)
    wanted = asked.select("query_id", "terms", F.explode("terms").alias("term"))
    wanted = F.broadcast(wanted) if plan_bytes(queries) <= BROADCAST_BYTES else wanted
    have = index.select("slug", "node_id", F.explode(F.array_distinct(F.concat("name_tokens", "body_tokens"))).alias("term"))
    return have.join(wanted, "term").groupBy("slug", "query_id", "node_id").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("terms")).alias("need")).filter("n = need").select("slug", "query_id", "node_id")


def search_lines(nodes: DataFrame, pattern: str, regex: bool = False, per_node: int = 5, around: int = 2) -> DataFrame:
    """(slug, node_id, line, text, context): the lines that hold ``pattern``, without case, or in which a regex is found.

    At most ``per_node`` lines a node, with ``around`` lines before and after.
    ``line`` counts from the node's line_start (0 if null). Only nodes whose
    content meets the pattern at all are split into lines.
    """
    rows = nodes.filter("id is not null and content is not null").select("slug", F.col("id").alias("node_id"), F.coalesce("line_start", F.lit(0)).alias("first"), "content")
    meets: Column = F.col("content").rlike(f"(?m){pattern}") if regex else F.contains(F.lower("content"), F.lit(pattern.lower()))
    rows = rows.filter(meets).dropDuplicates(["slug", "node_id"]).withColumn("lines", F.split("content", "\n"))
    hit = (lambda x: x.rlike(pattern)) if regex else (lambda x: F.contains(F.lower(x), F.lit(pattern.lower())))
    places = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: hit(F.get("lines", i)))
    found = rows.select("slug", "node_id", "first", "lines", F.explode(F.slice(places, 1, per_node)).alias("i"))
    start = F.greatest(F.lit(0), F.col("i") - around)
    context = F.array_join(F.slice("lines", start + 1, F.col("i") + around + 1 - start), "\n")
    return found.select("slug", "node_id", (F.col("first") + F.col("i")).alias("line"), F.regexp_replace(F.get("lines", F.col("i")), r"^\s+|\s+$", "").alias("text"), context.alias("context"))


def write_index(nodes: DataFrame, path: str) -> None:
    """The postings of each snapshot, replaced as a whole, also where a corpus has become empty."""
    postings(build_index(nodes)).write.mode("overwrite").partitionBy("slug").parquet(path)
