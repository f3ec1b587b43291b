"""Scalar functions, filters, ranking and search over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import lexical, ranking
from lodestrata.session import staged, table

#: The fixed query set of the search queries.
SEARCHES = [("s1", "inventory slot command"), ("s2", "how to register a harbour"), ("s3", "copper torch copper"), ("s4", "ScoutSnapshotTracker dropHarbour"), ("s5", "guard gate 42")]
QUESTIONS = [
    "What extends EntityBase", "which classes implement Codec", "who calls flushTrader", "methods of HingePlankRouter", "how to craft torch", "what drops from goblin", "what uses copper",
    "where to buy leather", "which ui shows Workbench", "find class Ledger", "rain on the farm", "Show ScoutSnapshotTracker please", "drops from npc merchants", "",
]


def _nodes(spark, d, *columns) -> DataFrame:
    """Each node once, with the columns asked for."""
    return table(spark, d, "nodes").filter("id is not null").select("slug", F.col("id").alias("node_id"), *columns).distinct()


def _searches(spark) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id string, query string")


def split_identifiers(spark, d):
    return _nodes(spark, d, "display_name").select("slug", "node_id", X.split_identifiers(F.col("display_name")).alias("words"))


def match_expressions(spark, d):
    return _nodes(spark, d, "display_name").select("slug", "node_id", X.match_expression(F.col("display_name")).alias("expression"))


def snippet_truncate(spark, d):
    return _nodes(spark, d, "content").select("slug", "node_id", F.md5(X.truncate(F.col("content"), 300)).alias("snippet"), F.length(X.truncate(F.col("content"), 300)).alias("n"))


def snippet_window(spark, d):
    return _nodes(spark, d, "content").select("slug", "node_id", F.md5(X.window(F.col("content"), F.lit("scheduler loaderBridge"), 200)).alias("snippet"))


def html_to_text(spark, d):
    return _nodes(spark, d, "content", "corpus").filter("corpus = 'docs'").select("slug", "node_id", F.md5(X.html_text(F.col("content"))).alias("text"))


def name_slugs(spark, d):
    return _nodes(spark, d, "display_name").select("slug", "node_id", X.slug(F.col("display_name")).alias("short"))


def published_dates(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normal_date(F.col("published_date")).alias("published"))


def method_signatures(spark, d):
    return _nodes(spark, d, "content", "corpus").filter("corpus = 'code'").select("slug", "node_id", X.method_name(F.col("node_id")).alias("method"), X.signature(F.col("content")).alias("signature"))


def metadata_facets(spark, d):
    facets = X.metadata_facets(F.col("metadata"))
    return _nodes(spark, d, "metadata").select("slug", "node_id", *(v.alias(k) for k, v in facets.items()))


def facet_filter(spark, d):
    """Nodes without metadata stay, those with metadata but another visibility go."""
    rows = _nodes(spark, d, "metadata", "corpus").filter("corpus = 'code'")
    visibility = X.metadata_facets(F.col("metadata"))["visibility"]
    return rows.filter(F.col("metadata").isNull() | (F.coalesce(visibility, F.lit("")) == "public")).select("slug", "node_id")


def class_and_path_filters(spark, d):
    rows = _nodes(spark, d, "display_name", "file_path")
    return rows.select(
        "slug", "node_id", X.class_matches(F.col("node_id"), "EntityBase").alias("class_exact"), (X.contains_ci(F.col("display_name"), "router") | X.contains_ci(F.col("file_path"), "router")).alias("class_part"),
        F.coalesce(X.path_matches(F.col("file_path"), "m00"), F.lit(False)).alias("path_exact"), (X.contains_ci(F.col("file_path"), "/region/") | X.contains_ci(F.col("node_id"), "/region/")).alias("path_part"),
    ).filter("class_exact or class_part or path_exact or path_part")


def type_filter(spark, d):
    return _nodes(spark, d, "data_type", "corpus").filter(F.col("data_type").isin("recipe", "item", "shop") & (F.col("corpus") == "gamedata")).select("slug", "node_id", "data_type")


def search_by_name(spark, d):
    """Exact names first, then those that begin so, then others; shorter first."""
    rows = _nodes(spark, d, "display_name").filter(F.col("display_name").ilike("%guard%"))
    tier = F.when(F.lower("display_name") == "guard", 0).when(F.col("display_name").ilike("guard%"), 1).otherwise(2)
    by = Window.partitionBy("slug").orderBy(tier, F.length("display_name"), "node_id")
    return rows.withColumn("rank", F.row_number().over(by)).filter("rank <= 20").select("slug", "node_id", "display_name", "rank")


def bm25_topk(spark, d):
    return lexical.bm25(staged(lexical.build_index(table(spark, d, "nodes"))), _searches(spark), limit=10, round_to=6)


def fts_and_candidates(spark, d):
    return lexical.match_all(lexical.build_index(table(spark, d, "nodes")), _searches(spark))


def text_grep(spark, d):
    return lexical.search_lines(table(spark, d, "nodes"), "Harbour")


def text_grep_regex(spark, d):
    return lexical.search_lines(table(spark, d, "nodes"), r"return\s+\d+;", regex=True)


def _lists(spark, d) -> DataFrame:
    """Two ranked lists a query: by weight of words and by name."""
    index = staged(lexical.build_index(table(spark, d, "nodes")))
    first = lexical.bm25(index, _searches(spark), limit=20, round_to=6).select("slug", "query_id", F.lit(0).alias("list_no"), "rank", "node_id")
    second = lexical.bm25(index, _searches(spark), limit=20, name_weight=0.0, round_to=6).select("slug", "query_id", F.lit(1).alias("list_no"), "rank", "node_id")
    return first.unionByName(second)


def rrf_fuse(spark, d):
    return ranking.rrf(_lists(spark, d), keys=("slug", "query_id")).withColumn("score", F.round("score", 9))


def rrf_unnormalised(spark, d):
    return ranking.rrf(_lists(spark, d), normalised=False, keys=("slug", "query_id")).withColumn("score", F.round("score", 9))


def corpus_penalty(spark, d):
    rows = _nodes(spark, d, "corpus", "data_type")
    return rows.select("slug", "node_id", ranking.penalised(F.lit(1.0), F.col("corpus"), F.col("node_id"), F.col("data_type")).alias("score")).filter("score < 1")


def recency_sort(spark, d):
    """The newest docs of each snapshot: date, then length as score, then id."""
    rows = _nodes(spark, d, "corpus", "published_date", "content").filter("corpus = 'docs'").groupBy("slug", "node_id").agg(F.max("published_date").alias("published_date"), F.max(F.length("content")).alias("score"))
    date = X.normal_date(F.col("published_date"))
    ranked = ranking.top(rows.withColumn("date", date), 50, ("slug",), [*ranking.recency_order(F.col("date"), F.coalesce("score", F.lit(0))), F.asc("node_id")])
    return ranked.select("slug", "node_id", "date", "rank")


def merge_duplicates(spark, d):
    """Edges as results of their targets: each target once in a snapshot, at its best."""
    edges = table(spark, d, "edges").filter("target_id is not null").groupBy("slug", "target_id", "id").agg(F.max("source_id").alias("source_id"), F.max("edge_type").alias("edge_type"), F.max("metadata").alias("metadata"))
    rows = edges.select("slug", F.col("id").alias("pos"), F.col("target_id").alias("node_id"), ((F.col("id") % 7) / 7.0).alias("score"), F.when(F.col("metadata").isNotNull(), F.col("source_id")).alias("bridged_from"), F.when(F.col("metadata").isNotNull(), F.col("edge_type")).alias("bridge_type"))
    return ranking.merge_duplicates(rows, ("slug",)).select("slug", "node_id", F.round("score", 9).alias("score"), "pos", "bridged_from", "bridge_type")


def _questions(spark) -> DataFrame:
    return spark.createDataFrame([(n, q) for n, q in enumerate(QUESTIONS)], "question int, query string")


def intent_rules(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.intents(F.coalesce("title", F.lit(""))).alias("types"))
    return rows.filter("types is not null")


def route_questions(spark, d):
    """The route of each question; named entities count if a node of any snapshot has that name."""
    names = table(spark, d, "nodes").filter("display_name is not null").select(F.substring_index("display_name", ".", -1).alias("entity")).distinct()
    q = _questions(spark).select("question", "query", X.route_rule(F.col("query")).alias("r"), F.concat(F.array(F.regexp_extract("query", X.FIND, 1)), F.regexp_extract_all("query", F.lit(X.CAPITALISED), F.lit(1))).alias("names"))
    named = q.filter("r is null").select("question", F.posexplode("names").alias("pos", "entity")).filter("entity <> ''").join(names, "entity").groupBy("question").agg(F.min_by("entity", "pos").alias("named"))
    out = q.join(named, "question", "left")
    strategy = F.when(F.col("r").isNotNull(), F.col("r.strategy")).when(F.col("named").isNotNull(), "HYBRID").otherwise("VECTOR")
    return out.select("question", strategy.alias("strategy"), "r.relation", F.coalesce("r.entity", "named").alias("entity"))


def jaccard_neighbours(spark, d):
    """Word overlap of the whole contents at both ends of each call."""
    edges = table(spark, d, "edges").filter("edge_type = 'CALLS'").select("slug", "source_id", "target_id").distinct()
    heads = table(spark, d, "nodes").filter("id is not null").groupBy("slug", "id").agg(F.max("content").alias("content")).select("slug", "id", X.snippet_tokens(F.col("content")).alias("words"))
    a, b = heads.select("slug", F.col("id").alias("source_id"), F.col("words").alias("wa")), heads.select("slug", F.col("id").alias("target_id"), F.col("words").alias("wb"))
    return edges.join(a, ["slug", "source_id"]).join(b, ["slug", "target_id"]).select("slug", "source_id", "target_id", F.round(X.jaccard(F.col("wa"), F.col("wb")), 9).alias("jaccard"))


QUERIES = {
    f.__name__: f
    for f in (
        split_identifiers, match_expressions, snippet_truncate, snippet_window, html_to_text, name_slugs, published_dates, method_signatures, metadata_facets, facet_filter, class_and_path_filters, type_filter,
        search_by_name, bm25_topk, fts_and_candidates, text_grep, text_grep_regex, rrf_fuse, rrf_unnormalised, corpus_penalty, recency_sort, merge_duplicates, intent_rules, route_questions, jaccard_neighbours,
    )
}

_N = "(SELECT DISTINCT slug, id AS node_id, {0} FROM nodes WHERE id IS NOT NULL)"
_WORDS = r"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"
_RUNS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda t: t <> '')"
_PARTS = "flatten(list_filter(list_transform(" + _RUNS + ", lambda t: " + _WORDS.format("t") + "), lambda w: len(w) > 1))"


def _idents(c: str) -> str:
    return f"(CASE WHEN len({_PARTS.format(c)}) > 0 THEN {c} || ' ' || array_to_string({_PARTS.format(c)}, ' ') ELSE {c} END)"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower({c}), '{X.FOLD_FROM}', '{X.FOLD_TO}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


_TRUNC = "(CASE WHEN length({c}) <= {n} THEN {c} WHEN regexp_matches(substring({c}, 1, {n}), '(?s)^.+\\n[^\\n]*$') THEN regexp_extract(substring({c}, 1, {n}), '(?s)^(.+)\\n[^\\n]*$', 1) || chr(10) || '…' ELSE substring({c}, 1, {n}) || chr(10) || '…' END)"
_SEARCH_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in SEARCHES)
_INDEX = f"""raw AS (SELECT slug, id, any_value(corpus) AS corpus, any_value(coalesce(display_name, '')) AS name, any_value(coalesce(content, '')) AS body FROM nodes WHERE id IS NOT NULL GROUP BY slug, id),
rows_ AS (SELECT slug, id, corpus, CASE WHEN corpus = 'code' THEN {_idents('name')} ELSE name END AS name, CASE WHEN corpus = 'code' THEN {_idents('body')} ELSE body END AS body FROM raw),
idx AS (SELECT slug, id AS node_id, {_tokens('name')} AS nt, {_tokens('body')} AS bt FROM rows_),
stats AS (SELECT slug, count(*) AS n, avg(len(nt) + len(bt)) AS avgdl FROM idx GROUP BY slug),
q(query_id, query) AS (VALUES {_SEARCH_VALUES}),
asked AS (SELECT query_id, lower(t) AS term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(query, '([A-Za-z0-9]+)', 1)) AS t FROM q) GROUP BY ALL),
post AS (SELECT slug, node_id, term, len(nt) + len(bt) AS dl, len(list_filter(nt, lambda x: x = term)) AS tn, len(list_filter(bt, lambda x: x = term)) AS tb FROM idx, (SELECT DISTINCT term FROM asked) WHERE list_contains(nt, term) OR list_contains(bt, term)),
df AS (SELECT slug, term, count(*) AS n_t FROM post GROUP BY ALL)"""


def _bm25(name_weight: float, limit: int, name: str, body_weight: float = 1.0) -> str:
    f = f"({name_weight} * tn + {body_weight} * tb)"
    return f"""{name}_s AS (SELECT p.slug, query_id, node_id, round(sum(times * CASE WHEN ln((n - n_t + 0.5) / (n_t + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n_t + 0.5) / (n_t + 0.5)) END * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post p JOIN asked USING (term) JOIN df ON df.slug = p.slug AND df.term = p.term JOIN stats s ON s.slug = p.slug GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY slug, query_id ORDER BY score DESC, node_id) - 1 AS rank FROM {name}_s QUALIFY rank < {limit})"""


_FUSED = f"WITH {_INDEX}, {_bm25(10.0, 20, 'a')}, {_bm25(0.0, 20, 'b')}, f AS (SELECT slug, query_id, node_id, sum(1.0::DOUBLE / (60 + rank + 1)) AS score, min(list_no) AS first_list FROM (SELECT *, 0 AS list_no FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL)"
_LOWER_HIT = "contains(lower({0}), 'harbour')"


def _grep(meets: str, hit: str) -> str:
    return f"""WITH r AS (SELECT slug, id AS node_id, any_value(coalesce(line_start, 0)) AS first, any_value(content) AS content FROM nodes WHERE id IS NOT NULL AND content IS NOT NULL AND {meets} GROUP BY slug, id),
l AS (SELECT *, string_split(content, chr(10)) AS ls FROM r), h AS (SELECT slug, node_id, first, ls, unnest(list_filter(range(0, len(ls)), lambda i: {hit})[1:5]) AS i FROM l)
SELECT slug, node_id, CAST(first + i AS INT) AS line, regexp_replace(ls[i + 1], '^\\s+|\\s+$', '', 'g') AS text, array_to_string(ls[greatest(0, i - 2) + 1 : i + 3], chr(10)) AS context FROM h"""


_FACET = """nullif(regexp_extract(metadata, '"visibility"\\s*:\\s*"([^"]*)"', 1), '')"""
_INNER = """regexp_extract(metadata, '"annotations"\\s*:\\s*\\[(.*)\\]', 1)"""
_DATE = """CASE WHEN regexp_matches(p, '^\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}') THEN regexp_extract(p, '^(\\d{4})', 1) || '-' || lpad(regexp_extract(p, '^\\d{4}[-/.](\\d{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(p, '^\\d{4}[-/.]\\d{1,2}[-/.](\\d{1,2})', 1), 2, '0')
  WHEN regexp_matches(p, '^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$') THEN regexp_extract(p, '(\\d{4})$', 1) || '-' || lpad(regexp_extract(p, '^\\d{1,2}\\.(\\d{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(p, '^(\\d{1,2})', 1), 2, '0') END"""
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_HTML = "content"
for _pattern in ("(?is)<script\\b.*?</script>", "(?is)<style\\b.*?</style>", "(?s)<[^>]+>"):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', ' ', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_name}', '{_char}')"
_INTENT = "flatten([CASE WHEN regexp_matches(t, '(?i)\\b(?:drop|loot)s?\\s+from\\b') THEN ['drop', 'npc'] ELSE []::VARCHAR[] END, " + ", ".join(f"CASE WHEN regexp_matches(t, '(?i)\\b(?:{w})s?\\b') THEN {list(ty)!r} ELSE []::VARCHAR[] END" for w, ty in X.INTENTS) + "])"
_INTENT_SQL = f"SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS types FROM (SELECT doc_id, {_INTENT} AS l FROM (SELECT doc_id, coalesce(title, '') AS t FROM documents)) WHERE len(l) > 0"
_SNIP = "list_distinct(list_transform(regexp_extract_all(coalesce(substring(content, 1, 400), ''), '(\\w+)', 1), lambda x: lower(x)))"

SQL = {
    "split_identifiers": f"SELECT slug, node_id, {_idents('display_name')} AS words FROM {_N.format('display_name')}",
    "match_expressions": f"""SELECT slug, node_id, CASE WHEN len(t) > 0 THEN array_to_string(list_transform(t, lambda x: '"' || x || '"'), ' OR ') END AS expression FROM (SELECT *, regexp_extract_all(display_name, '([A-Za-z0-9]+)', 1) AS t FROM {_N.format('display_name')})""",
    "snippet_truncate": f"SELECT slug, node_id, md5({_TRUNC.format(c='content', n=300)}) AS snippet, CAST(length({_TRUNC.format(c='content', n=300)}) AS INT) AS n FROM {_N.format('content')}",
    "snippet_window": f"""WITH r AS (SELECT *, list_min(list_filter([strpos(lower(content), 'scheduler'), strpos(lower(content), 'loaderbridge'), strpos(lower(content), 'loader'), strpos(lower(content), 'bridge')], lambda p: p > 0)) - 1 AS f FROM {_N.format('content')}),
s AS (SELECT *, greatest(0, least(f - 100, length(content) - 200)) AS st FROM r)
SELECT slug, node_id, md5(CASE WHEN length(content) <= 200 THEN content WHEN f >= 200 THEN CASE WHEN st > 0 THEN '…' ELSE '' END || substring(content, st + 1, 200) || CASE WHEN st + 200 < length(content) THEN '…' ELSE '' END ELSE {_TRUNC.format(c='content', n=200)} END) AS snippet FROM s""",
    "html_to_text": f"SELECT slug, node_id, md5({_TRIM.format(f'''regexp_replace({_HTML}, '{chr(92)}s+', ' ', 'g')''')}) AS text FROM {_N.format('content, corpus')} WHERE corpus = 'docs'",
    "name_slugs": f"SELECT slug, node_id, substring(regexp_replace(regexp_replace(lower(display_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS short FROM {_N.format('display_name')}",
    "published_dates": f"SELECT doc_id, {_DATE} AS published FROM (SELECT doc_id, {_TRIM.format('published_date')} AS p FROM documents)",
    "method_signatures": f"""SELECT slug, node_id, CASE WHEN contains(node_id, '#') THEN string_split(node_id, '#')[-1] END AS method,
  coalesce(list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^(//|/\\*|\\*|@)'))[1], '') AS signature FROM {_N.format('content, corpus')} WHERE corpus = 'code'""",
    "metadata_facets": f"""SELECT slug, node_id, {_FACET} AS visibility, CASE WHEN {_INNER} <> '' THEN array_to_string(list_transform(list_distinct_ordered, lambda x: x), ',') END AS annotations, coalesce(regexp_matches(metadata, '"thin"\\s*:\\s*true'), false) AS thin
FROM (SELECT *, list_filter(names, lambda x, i: list_position(names, x) = i) AS list_distinct_ordered FROM (SELECT *, regexp_extract_all({_INNER}, '"name"\\s*:\\s*"([^"]*)"', 1) AS names FROM {_N.format('metadata')}))""",
    "facet_filter": f"SELECT slug, node_id FROM {_N.format('metadata, corpus')} WHERE corpus = 'code' AND (metadata IS NULL OR coalesce({_FACET}, '') = 'public')",
    "class_and_path_filters": f"""SELECT * FROM (SELECT slug, node_id, regexp_replace(split_part(node_id, '#', 1), '^class:', '') = 'EntityBase' OR string_split(regexp_replace(split_part(node_id, '#', 1), '^class:', ''), '.')[-1] = 'EntityBase' AS class_exact,
  contains(lower(coalesce(display_name, '')), 'router') OR contains(lower(coalesce(file_path, '')), 'router') AS class_part,
  coalesce(string_split(file_path, '/')[-1] = 'm00' OR (contains(file_path, '/m00') AND substring(file_path, strpos(file_path, '/m00') + 4, 1) IN ('', '/')), false) AS path_exact,
  contains(lower(coalesce(file_path, '')), '/region/') OR contains(lower(node_id), '/region/') AS path_part FROM {_N.format('display_name, file_path')}) WHERE class_exact OR class_part OR path_exact OR path_part""",
    "type_filter": f"SELECT slug, node_id, data_type FROM {_N.format('data_type, corpus')} WHERE data_type IN ('recipe', 'item', 'shop') AND corpus = 'gamedata'",
    "search_by_name": f"SELECT slug, node_id, display_name, row_number() OVER (PARTITION BY slug ORDER BY CASE WHEN lower(display_name) = 'guard' THEN 0 WHEN display_name ILIKE 'guard%' THEN 1 ELSE 2 END, length(display_name), node_id) AS rank FROM {_N.format('display_name')} WHERE display_name ILIKE '%guard%' QUALIFY rank <= 20",
    "bm25_topk": f"WITH {_INDEX}, {_bm25(10.0, 10, 'a')} SELECT * FROM a",
    "fts_and_candidates": f"WITH {_INDEX}, need AS (SELECT query_id, count(*) AS k FROM asked GROUP BY ALL) SELECT p.slug, a.query_id, p.node_id FROM post p JOIN asked a USING (term) JOIN need n ON n.query_id = a.query_id GROUP BY p.slug, a.query_id, p.node_id, n.k HAVING count(DISTINCT term) = n.k",
    "text_grep": _grep(_LOWER_HIT.format("content"), _LOWER_HIT.format("ls[i + 1]")),
    "text_grep_regex": _grep("regexp_matches(content, 'return\\s+\\d+;')", "regexp_matches(ls[i + 1], 'return\\s+\\d+;')"),
    "rrf_fuse": f"{_FUSED} SELECT slug, query_id, node_id, round(score / max(score) OVER (PARTITION BY slug, query_id), 9) AS score, first_list FROM f",
    "rrf_unnormalised": f"{_FUSED} SELECT slug, query_id, node_id, round(score, 9) AS score, first_list FROM f",
    "corpus_penalty": f"SELECT * FROM (SELECT slug, node_id, CASE WHEN corpus = 'docs' AND starts_with(node_id, 'blog:') THEN 0.85::DOUBLE ELSE 1.0 END * CASE WHEN corpus = 'gamedata' AND data_type IN {ranking.WORLD_TYPES} THEN 0.5::DOUBLE ELSE 1.0 END AS score FROM {_N.format('corpus, data_type')}) WHERE score < 1",
    "recency_sort": f"WITH r AS (SELECT slug, id AS node_id, max(published_date) AS pd, max(length(content)) AS score FROM nodes WHERE corpus = 'docs' AND id IS NOT NULL GROUP BY ALL), t AS (SELECT slug, node_id, score, {_DATE} AS date FROM (SELECT *, {_TRIM.format('pd')} AS p FROM r)) SELECT slug, node_id, date, row_number() OVER (PARTITION BY slug ORDER BY coalesce(date, '') DESC, coalesce(score, 0) DESC, node_id) - 1 AS rank FROM t QUALIFY rank < 50",
    "merge_duplicates": """WITH e AS (SELECT slug, target_id AS node_id, id AS pos, (id % 7) / 7.0::DOUBLE AS score, CASE WHEN max(metadata) IS NOT NULL THEN max(source_id) END AS f, CASE WHEN max(metadata) IS NOT NULL THEN max(edge_type) END AS t FROM edges WHERE target_id IS NOT NULL GROUP BY ALL)
SELECT slug, node_id, round(max(score), 9) AS score, min(pos) AS pos, arg_min(f, (-score, pos)) FILTER (f IS NOT NULL) AS bridged_from, arg_min(t, (-score, pos)) FILTER (t IS NOT NULL) AS bridge_type FROM e GROUP BY ALL""",
    "intent_rules": _INTENT_SQL,
    "jaccard_neighbours": f"""WITH h AS (SELECT slug, id, {_SNIP} AS w FROM (SELECT slug, id, max(content) AS content FROM nodes WHERE id IS NOT NULL GROUP BY ALL)), e AS (SELECT DISTINCT slug, source_id, target_id FROM edges WHERE edge_type = 'CALLS')
SELECT e.slug, source_id, target_id, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END, 9) AS jaccard FROM e JOIN h a ON a.slug = e.slug AND a.id = source_id JOIN h b ON b.slug = e.slug AND b.id = target_id""",
}
