"""The engine: search, traversal, lookup, differences and statistics over one data folder's versions.

Methods return DataFrames with a ``rank`` where order matters. Branches of a
search are plans that are united and fused in one job; only results, which the
limits bound, are meant to be collected. Arguments out of range are clamped.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import catalog, diffing, embedding, graph, lexical, ranking
from lodestrata.operators.encoding import rows_of
from lodestrata.session import table

CORPORA = ("code", "client", "gamedata", "docs")
#: From which corpus which edges lead where when results are widened.
BRIDGES = (("gamedata", "IMPLEMENTED_BY", True, "code"), ("gamedata", "UI_BINDS_TO", False, "client"), ("code", "IMPLEMENTED_BY", False, "gamedata"), ("client", "UI_BINDS_TO", True, "gamedata"), ("docs", "DOCS_REFERENCES", True, "code"), ("docs", "DOCS_REFERENCES", True, "gamedata"))


@dataclass(frozen=True)
class Settings:
    """Parameters of ranking; one object goes to every plan."""

    rrf_k: int = 60
    lexical_limit: int = 100
    name_weight: float = 10.0
    body_weight: float = 1.0
    blog_penalty: float = 0.85
    world_penalty: float = 0.5
    near_dup_penalty: float = 0.5
    near_dup_jaccard: float = 0.8
    delegate_penalty: float = 1.0
    expansion_discount: float = 0.4
    min_seed_score: float = 0.5
    min_result_score: float = 0.35
    per_seed_cap: int = 3
    score_floor: float = 0.70
    gamedata_limit: int = 200
    snippet_max: int = 1500
    source_max: int = 20_000
    hybrid: bool = True


def clamp(value: float | None, default: int, most: int, least: int = 1) -> int:
    return max(least, min(most, int(value if value is not None else default)))


class Engine:
    """One version of the data: ``patchline`` (its newest version) or ``patchline@version``, or a slug."""

    def __init__(self, spark: SparkSession, root: str, version: str = "release", backend: embedding.EmbeddingBackend | None = None, vectors: DataFrame | None = None, settings: Settings = Settings(), reranker=None) -> None:
        self.spark, self.root, self.settings, self.reranker = spark, root, settings, reranker
        self.meta = table(spark, root, "version_meta")
        self.slug = self._resolve(version)
        self.all_nodes, self.all_edges = table(spark, root, "nodes"), table(spark, root, "edges")
        self.nodes = self.all_nodes.filter((F.col("slug") == self.slug) & F.col("id").isNotNull()).dropDuplicates(["slug", "id"])
        self.edges = self.all_edges.filter(F.col("slug") == self.slug)
        self.backend = backend or embedding.HashingBackend()
        self._vectors, self._index = vectors, None

    def _resolve(self, version: str) -> str:
        patchline, _, ref = version.partition("@")
        lines = self.meta.filter(F.col("patchline") == patchline)
        found = catalog.latest_versions(lines).select("slug").collect() if not ref else []
        if not found:
            asked = self.spark.createDataFrame([(ref or version,)], "ref string")
            found = [r for r in catalog.resolve_versions(lines if ref else self.meta, asked).select("slug").collect() if r["slug"]]
        if not found:
            raise LookupError(f"no such version: {version}")
        return found[0]["slug"]

    @property
    def index(self) -> DataFrame:
        """The full-text index of the version, kept in memory while the engine lives."""
        if self._index is None:
            self._index = lexical.build_index(self.nodes).persist()
        return self._index

    @property
    def vectors(self) -> DataFrame:
        """(node_id, corpus, vector) of the nodes with an embedding text, embedded once."""
        if self._vectors is None:
            told = self.nodes.filter("embedding_text is not null").select(F.col("id").alias("node_id"), "corpus", "embedding_text")
            self._vectors = embedding.embed_column(told, "embedding_text", self.backend).select("node_id", "corpus", "vector").persist()
        return self._vectors

    # ---- branches of a search: (query_id, list_no, rank, node_id[, score])

    def _query(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([("q", query)], "query_id string, query string")

    def _lexical(self, query: str, corpus: str | None, limit: int) -> DataFrame:
        s = self.settings
        return lexical.bm25(self.index, self._query(query), corpus, limit, s.name_weight, s.body_weight).select("query_id", "rank", "node_id", "score")

    def _semantic(self, query: str, corpus: str | None, limit: int) -> DataFrame:
        asked = self.spark.createDataFrame([("", [float(x) for x in self.backend.embed([query], "query")[0]])], "node_id string, vector array<double>")
        rows = self.vectors if corpus is None else self.vectors.filter(F.col("corpus") == corpus)
        near = embedding.nearest(rows, asked, limit, "node_id", "vector")
        return near.select(F.lit("q").alias("query_id"), "rank", "node_id", embedding.similarity_score(F.col("score")).alias("score"))

    def _named(self, name: str, corpus: str | None, limit: int) -> DataFrame:
        pattern = name.replace("\\", "\\\\")
        rows = self.nodes.filter(F.col("display_name").ilike(f"%{pattern}%"))
        rows = rows if corpus is None else rows.filter(F.col("corpus") == corpus)
        tier = F.when(F.lower("display_name") == name.lower(), 0).when(F.col("display_name").ilike(f"{pattern}%"), 1).otherwise(2)
        ranked = ranking.top(rows.select(F.lit("q").alias("query_id"), F.col("id").alias("node_id"), tier.alias("tier"), F.length("display_name").alias("n")), limit, order=[F.asc("tier"), F.asc("n"), F.asc("node_id")])
        return ranked.select("query_id", "rank", "node_id", F.lit(1.0).alias("score"))

    def route(self, query: str) -> tuple[str, str | None, str | None]:
        """(strategy, relation, entity) of a question."""
        one = self._query(query).select(X.route_rule(F.col("query")).alias("r"), F.concat(F.array(F.regexp_extract("query", X.FIND, 1)), F.regexp_extract_all("query", F.lit(X.CAPITALISED), F.lit(1))).alias("names")).collect()[0]
        if one["r"] is not None:
            return one["r"]["strategy"], one["r"]["relation"], one["r"]["entity"]
        names = [n for n in one["names"] if n]
        known = {r[0] for r in self.nodes.select(F.substring_index("display_name", ".", -1).alias("n")).filter(F.col("n").isin(names)).distinct().collect()} if names else set()
        entity = next((n for n in names if n in known), None)
        return ("HYBRID", None, entity) if entity else ("VECTOR", None, None)

    def _by_graph(self, relation: str, entity: str, limit: int) -> DataFrame:
        names = self.spark.createDataFrame([(self.slug, entity)], "slug string, name string")
        if relation in ("EXTENDS", "IMPLEMENTS", "CONTAINS"):
            hits = graph.by_relation(self.edges, self.nodes, names, relation).select("node_id", "score")
        else:
            refs = graph.resolve_ids(self.nodes, names.withColumnRenamed("name", "ref")).filter("node_id is not null").select("slug", F.col("node_id").alias("seed_id"))
            if relation == "CALLS":
                found = graph.callers(self.edges, self.nodes, limit)
            elif relation == "DROPS_ON_DEATH":
                found = graph.two_hops(self.edges, self.nodes, "DROPS_ON_DEATH", "DROPS_ITEM", limit)
            else:
                found = graph.both_ways(self.edges, self.nodes, relation, limit)
            hits = found.join(refs, ["slug", "seed_id"], "left_semi").select("node_id", F.lit(1.0).alias("score"))
        return ranking.top(hits.groupBy(F.lit("q").alias("query_id"), "node_id").agg(F.max("score").alias("score")), limit).select("query_id", "rank", "node_id", "score")

    def _routed(self, query: str, corpus: str | None, limit: int) -> DataFrame:
        strategy, relation, entity = self.route(query)
        if strategy == "VECTOR" or relation is None:
            return self._semantic(query, corpus, limit)
        near = self._by_graph(relation, entity, limit)
        if strategy == "GRAPH":
            return near
        both = near.withColumn("list_no", F.lit(0)).unionByName(self._semantic(query, corpus, limit).withColumn("list_no", F.lit(1)))
        return ranking.top(ranking.rrf(both, self.settings.rrf_k, False), limit).select("query_id", "rank", "node_id", "score")

    def _fused(self, lists: list[DataFrame]) -> DataFrame:
        tagged = [x.select("query_id", "rank", "node_id", F.lit(n).alias("list_no")) for n, x in enumerate(lists)]
        out = tagged[0]
        for x in tagged[1:]:
            out = out.unionByName(x)
        return ranking.rrf(out, self.settings.rrf_k)

    def _shown(self, scored: DataFrame) -> DataFrame:
        """Scored node ids with what results show of them."""
        heads = self.nodes.select(F.col("id").alias("node_id"), "display_name", "file_path", "line_start", "corpus", "data_type", "published_date", "metadata", F.when(F.col("corpus") == "code", F.col("content")).otherwise(F.coalesce("embedding_text", "content", F.lit(""))).alias("snippet"))
        return scored.join(heads, "node_id").withColumn("thin", X.metadata_facets(F.col("metadata"))["thin"])

    def _final(self, results: DataFrame, query: str, limit: int, order: list[Column] | None = None) -> DataFrame:
        s = self.settings
        if self.reranker is not None:
            results = self._reranked(results, query)
        spread = ranking.diversify(results.select("query_id", "node_id", "display_name", "snippet", "thin", "score"), s.near_dup_penalty, s.near_dup_jaccard, s.delegate_penalty) if order is None else results
        rest = results.drop("display_name", "snippet", "thin", "score")
        out = ranking.top(spread.join(rest, ["query_id", "node_id"]) if order is None else spread, limit, order=order)
        return out.withColumn("snippet", X.window(F.col("snippet"), F.lit(query), s.snippet_max)).drop("query_id", "thin", "first_list", "metadata")

    def _reranked(self, results: DataFrame, query: str, most: int = 50) -> DataFrame:
        """The best ``most`` put in the reranker's order: a function of query and texts that gives (index, relevance) pairs."""
        top = ranking.top(results, most).orderBy("rank").select("node_id", "snippet").collect()
        if len(top) < 2:
            return results
        order = [("q", top[i]["node_id"], place, float(v)) for place, (i, v) in enumerate(self.reranker(query, [r["snippet"] or "" for r in top])) if 0 <= i < len(top)]
        if not order:
            return results
        named = self.spark.createDataFrame(order, "query_id string, node_id string, place int, relevance double")
        joined = results.join(named, ["query_id", "node_id"], "left")
        return joined.withColumn("score", F.when(F.col("place").isNotNull(), 1 - F.col("place") / F.lit(len(order))).otherwise(F.col("score"))).drop("place")

    # ---- searches

    def search_code(self, query: str, limit: int | None = 5, class_filter: str | None = None, class_exact: bool = False, path_prefix: str | None = None, path_exact: bool = False, visibility: str | None = None, annotation: str | None = None) -> DataFrame:
        """Names, meaning and words fused, then filters, then near duplicates lowered."""
        if not query.strip():
            return self._empty()
        limit = clamp(limit, 5, 20)
        wide = 5 if path_prefix else 1
        lists = [self._named(query, "code", limit * wide), self._routed(query, "code", limit * (5 if path_prefix else 2))]
        if self.settings.hybrid:
            lists.append(self._lexical(query, "code", self.settings.lexical_limit))
        found = self._shown(self._fused(lists))
        if class_filter:
            found = found.filter(X.class_matches(F.col("node_id"), class_filter) if class_exact else X.contains_ci(F.col("display_name"), class_filter) | X.contains_ci(F.col("file_path"), class_filter))
        if path_prefix:
            found = found.filter(X.path_matches(F.col("file_path"), path_prefix) if path_exact else X.contains_ci(F.col("file_path"), path_prefix) | X.contains_ci(F.col("node_id"), path_prefix))
        facets = X.metadata_facets(F.col("metadata"))
        if visibility:
            found = found.filter(F.col("metadata").isNull() | (F.coalesce(facets["visibility"], F.lit("")) == visibility))
        if annotation:
            found = found.filter(F.col("metadata").isNull() | F.array_contains(F.split(F.coalesce(facets["annotations"], F.lit("")), ","), annotation))
        return self._final(found, query, limit)

    def search_corpus(self, query: str, corpus: str, limit: int | None = 5, types: list[str] | None = None, contains: str | None = None, newest: bool = False, source: str | None = None) -> DataFrame:
        """Meaning and words fused, penalties, then filters, then the order asked for."""
        if not query.strip():
            return self._empty()
        if corpus == "code":
            return self.search_code(query, limit, (types or [None])[0])
        limit = clamp(limit, 5, 20)
        if corpus == "gamedata" and types is None:
            told = self._query(query).select(X.intents(F.col("query"))).collect()[0][0]
            types = told.split(",") if told else None
        fetch = max(5 * limit, self.settings.gamedata_limit) if types or contains or newest or source or corpus == "gamedata" else limit
        lists = [self._semantic(query, corpus, fetch)] + ([self._lexical(query, corpus, self.settings.lexical_limit)] if self.settings.hybrid else [])
        s = self.settings
        found = self._shown(self._fused(lists))
        found = found.withColumn("score", ranking.penalised(F.col("score"), F.col("corpus"), F.col("node_id"), F.col("data_type"), s.blog_penalty, s.world_penalty))
        if types:
            found = found.filter(F.col("data_type").isin(types))
        if contains and contains.strip():
            found = found.filter(X.contains_ci(F.col("snippet"), contains))
        if source and source != "all":
            found = found.filter(F.col("node_id").startswith(f"{source}:"))
        order = [*ranking.recency_order(F.col("published_date"), F.col("score")), F.asc("node_id")] if newest else None
        return self._final(found, query, limit, order)

    def search_expanded(self, query: str, corpora: list[str], per_corpus: int = 5, extra: int = 5) -> DataFrame:
        """Results of each corpus and what their bridges to others lead to; a seed's ``connected`` lists what it brought."""
        s, parts = self.settings, []
        for c in corpora:
            rows = self.search_corpus(query, c, per_corpus).select("node_id", "score")
            parts.append(rows.filter(F.col("score") >= s.score_floor) if c == "gamedata" else rows)
        direct = parts[0]
        for p in parts[1:]:
            direct = direct.unionByName(p)
        direct = direct.groupBy(F.lit("q").alias("query_id"), "node_id").agg(F.max("score").alias("score"))
        kept = graph.unique_edges(self.edges)
        of = self.nodes.select(F.col("id"), "corpus")
        links = None
        for here, kind, out, there in BRIDGES:
            if there not in corpora and here not in corpora:
                continue
            a, b = ("source_id", "target_id") if out else ("target_id", "source_id")
            part = kept.filter(F.col("edge_type") == kind).select(F.col(a).alias("seed_id"), F.col(b).alias("node_id"), "edge_type", "seq")
            part = part.join(of.filter(F.col("corpus") == here).select(F.col("id").alias("seed_id")), "seed_id", "left_semi").join(of.filter(F.col("corpus") == there).select(F.col("id").alias("node_id")), "node_id", "left_semi")
            links = part if links is None else links.unionByName(part)
        brought = ranking.top(ranking.expand(direct, links.dropDuplicates(["seed_id", "node_id", "edge_type"]), s.expansion_discount, s.min_seed_score, s.min_result_score, s.per_seed_cap), extra).drop("rank")
        connected = brought.groupBy("query_id", F.col("bridged_from").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set(F.col("node_id"))), ",").alias("connected"))
        all_ = direct.join(connected, ["query_id", "node_id"], "left").withColumns({"bridged_from": F.lit(None).cast("string"), "bridge_type": F.lit(None).cast("string")}).unionByName(brought.withColumn("connected", F.lit(None).cast("string")))
        return self._final(self._shown(all_), query, len(corpora) * per_corpus + extra)

    def search(self, query: str, limit: int | None = 20) -> DataFrame:
        """All corpora in one list: each corpus's best, then the best of all, each node once."""
        limit = clamp(limit, 20, 100)
        parts = [self.search_corpus(query, c, limit).select("node_id", "score") for c in CORPORA]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        best = out.groupBy(F.lit("q").alias("query_id"), "node_id").agg(F.max("score").alias("score"))
        return self._final(self._shown(best), query, limit)

    def topic_context(self, topic: str, limit: int = 4) -> dict[str, DataFrame]:
        """What one should read about a topic, by section."""
        return {"docs": self.search_corpus(topic, "docs", limit, source="modding"), "code": self.search_code(topic, limit), "gamedata": self.search_corpus(topic, "gamedata", limit)}

    def search_text(self, pattern: str, regex: bool = False, corpus: str = "code", limit: int | None = 20, exhaustive: bool = False) -> DataFrame:
        """Lines with a literal or regex. A literal is looked for in nodes that have all its words; if there are none, or ``exhaustive``, in all."""
        rows = self.nodes.filter(F.col("corpus") == corpus)
        if not regex and not exhaustive:
            able = lexical.match_all(self.index, self._query(pattern)).select(F.col("node_id").alias("id"))
            if not able.isEmpty():
                rows = rows.join(able, "id", "left_semi")
        found = lexical.search_lines(rows, pattern, regex)
        return ranking.top(found.withColumn("query_id", F.lit("q")), clamp(limit, 20, 100), order=[F.asc("node_id"), F.asc("line")]).drop("query_id")

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "node_id string, score double, display_name string, file_path string, line_start int, corpus string, data_type string, published_date string, snippet string, rank int")

    # ---- traversal and lookup; ``node`` is an id or a name

    def _seed(self, node: str) -> DataFrame:
        refs = self.spark.createDataFrame([(self.slug, node)], "slug string, ref string")
        return graph.resolve_ids(self.nodes, refs).filter("resolution in ('exact', 'name')").select("slug", F.col("node_id").alias("seed_id"))

    def _around(self, node: str, edge: str, outgoing: bool, limit: int | None, condition: Column | None = None, default: int = 10) -> DataFrame:
        return graph.neighbours(self.edges, self.nodes, [edge], outgoing, self._seed(node), condition, clamp(limit, default, 50)).drop("slug", "seed_id")

    def recipe(self, node: str, direction: str = "both", limit: int | None = 10) -> dict[str, DataFrame]:
        seed = self._seed(node)
        of = lambda edge: graph.both_ways(self.edges, self.nodes, edge, clamp(limit, 10, 50)).join(seed, ["slug", "seed_id"], "left_semi")
        return {k: of(e) for k, e in (("inputs", "REQUIRES_ITEM"), ("outputs", "PRODUCES_ITEM")) if direction in ("both", k)}

    def drops(self, node: str, limit: int | None = 10) -> DataFrame:
        return graph.two_hops(self.edges, self.nodes, "DROPS_ON_DEATH", "DROPS_ITEM", clamp(limit, 10, 50)).join(self._seed(node), ["slug", "seed_id"], "left_semi")

    def implementing_code(self, node: str, limit: int | None = 10) -> DataFrame:
        return self._around(node, "IMPLEMENTED_BY", True, limit, F.col("node_type") == "JavaClass")

    def gamedata_for_code(self, node: str, limit: int | None = 5) -> DataFrame:
        return self._around(node, "IMPLEMENTED_BY", False, limit, F.col("corpus") == "gamedata", 5)

    def shops(self, node: str, limit: int | None = 10) -> DataFrame:
        return self._around(node, "OFFERED_IN_SHOP", False, limit, F.col("corpus") == "gamedata")

    def group_members(self, node: str, limit: int | None = 10) -> DataFrame:
        return self._around(node, "HAS_MEMBER", True, limit, F.col("corpus") == "gamedata")

    def usages(self, node: str, direction: str = "callers", limit: int | None = 10) -> DataFrame:
        made = graph.callers if direction == "callers" else graph.callees
        return made(self.edges, self.nodes, clamp(limit, 10, 50)).join(self._seed(node), ["slug", "seed_id"], "left_semi").drop("slug", "seed_id")

    def related(self, node: str, direction: str = "both", edge_types: list[str] | None = None, depth: int | None = 1, limit: int | None = 25) -> DataFrame:
        return graph.related(self.edges, self.nodes, self._seed(node), edge_types, direction, clamp(depth, 1, 3), clamp(limit, 25, 200)).drop("slug", "seed_id")

    def node(self, node: str) -> dict[str, DataFrame]:
        """The node, its edges, and suggestions if it isn't known."""
        seed = self._seed(node)
        mine = self.nodes.join(seed.withColumnRenamed("seed_id", "id"), ["slug", "id"], "left_semi")
        return {"node": mine, "edges": graph.node_edges(self.edges, mine).drop("slug", "seed_id"), "suggestions": graph.name_suggestions(self.nodes, node).drop("slug")}

    def class_methods(self, name: str) -> DataFrame:
        seed = self._seed(name).withColumnRenamed("seed_id", "class_id")
        return graph.class_methods(self.edges, self.nodes).join(seed, ["slug", "class_id"], "left_semi").join(self.nodes.select(F.col("id").alias("node_id"), "line_start", "line_end", X.signature(F.col("content")).alias("head")), "node_id").drop("slug")

    def file_paths(self, query: str, limit: int | None = 10) -> DataFrame:
        """Files of nodes whose name or path holds the query, exact names first."""
        pattern = query.replace("\\", "\\\\")
        rows = self.nodes.filter((F.col("display_name").ilike(f"%{pattern}%") | F.col("file_path").ilike(f"%{pattern}%")) & F.col("file_path").isNotNull()).select("display_name", "file_path", "node_type", "corpus").distinct()
        tier = F.when(F.lower("display_name") == query.lower(), 0).when(F.col("display_name").ilike(f"{pattern}%"), 1).otherwise(2)
        return ranking.top(rows.withColumn("query_id", F.lit("q")).withColumn("node_id", F.col("file_path")), clamp(limit, 10, 50), order=[tier.asc(), F.length("display_name").asc(), F.asc("file_path"), F.asc("display_name")]).drop("query_id", "node_id")

    def source(self, path: str | None = None, node: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """(file_path, line_start, line_end, text): a node's content, or a file's methods in order, lines clamped, cut to the most that is shown."""
        rows = self.nodes.join(self._seed(node).withColumnRenamed("seed_id", "id"), ["slug", "id"], "left_semi") if node else self.nodes.filter(F.col("file_path").endswith(inner_path(path)))
        first = F.coalesce("line_start", F.lit(1))
        lines = F.split("content", "\n")
        low = F.greatest(F.lit(1), F.lit(start or 1) - first + 1) if start else F.lit(1)
        high = F.least(F.size(lines), F.lit(end) - first + 1) if end else F.size(lines)
        text = F.array_join(F.slice(lines, low, F.greatest(F.lit(0), high - low + 1)), "\n")
        return rows.filter("content is not null").select("file_path", (first + low - 1).alias("line_start"), (first + high - 1).alias("line_end"), F.substring(text, 1, self.settings.source_max).alias("text")).orderBy("file_path", "line_start")

    def stats(self) -> dict[str, DataFrame]:
        return {"nodes": catalog.stats_nodes(self.nodes), "edges": catalog.stats_edges(self.edges, self.nodes)}

    def versions(self) -> DataFrame:
        return self.meta.dropDuplicates(["slug"]).orderBy(*catalog.newest_first())

    def diff(self, old: str = "release", new: str = "pre-release", limit: int | None = 50, **filters) -> dict[str, DataFrame]:
        """Entries (filtered, limited), summary (of all), cross references and skipped corpora between two versions."""
        a, b = (diffing.node_states(self.all_nodes, self._resolve(v)) for v in (old, new))
        whole = diffing.version_diff(a, b)
        entries = diffing.version_diff(a, b, **filters) if filters else whole
        top = ranking.top(entries.withColumn("query_id", F.lit("q")), clamp(limit, 50, 200), order=[F.asc("place"), F.asc("id")]).drop("query_id")
        edges = self.all_edges.filter(F.col("slug") == self._resolve(new))
        return {"entries": top, "summary": diffing.summary(whole), "references": diffing.cross_references(whole, edges), "skipped": diffing.skipped_corpora(a, b)}

    def encoded(self, results: DataFrame, verbosity: str = "compact") -> str:
        """Results as text; they are few, as every search is limited."""
        rows = [r.asDict() for r in results.orderBy("rank").collect()]
        return rows_of([{**r, "source": "HYBRID", "doc_source": (r.get("node_id") or "").split(":", 1)[0] if r.get("corpus") == "docs" else ""} for r in rows], verbosity)

    def with_settings(self, **changes) -> Engine:
        other = object.__new__(Engine)
        other.__dict__.update(self.__dict__)
        other.settings = replace(self.settings, **changes)
        return other


def inner_path(path: str | None) -> str:
    """A path that leads out of its root is refused."""
    if not path or ".." in path.split("/"):
        raise ValueError("a path within the source is needed")
    return path.lstrip("/")


#: The calls of the query surface: name, method, and how the arguments' names differ.
TOOLS = {
    "search": "search", "search_code": "search_code", "search_client_code": "search_corpus", "search_gamedata": "search_corpus", "search_docs": "search_corpus", "search_text": "search_text", "topic_context": "topic_context", "stats": "stats",
    "diff_versions": "diff", "file_path": "file_paths", "class": "class_methods", "source": "source", "node": "node", "related": "related", "recipe": "recipe", "drops": "drops", "implementing_code": "implementing_code",
    "gamedata_for_code": "gamedata_for_code", "usages": "usages", "shops": "shops", "group_members": "group_members", "list_versions": "versions",
}
_CORPUS = {"search_client_code": "client", "search_gamedata": "gamedata", "search_docs": "docs"}


def call(engine: Engine, tool: str, arguments: dict) -> dict:
    """A tool by name: {"content": text} or {"error": text}; a missing or wrong argument is an error, no exception."""
    if tool not in TOOLS:
        return {"error": f"unknown tool: {tool}"}
    arguments = dict(arguments)
    verbosity = arguments.pop("verbosity", "compact")
    if tool in _CORPUS:
        arguments["corpus"] = _CORPUS[tool]
    try:
        out = getattr(engine, TOOLS[tool])(**arguments)
        if isinstance(out, dict):
            import json

            return {"content": json.dumps({k: [r.asDict(recursive=True) for r in v.collect()] for k, v in out.items()}, default=str, ensure_ascii=False)}
        if "score" in out.columns and "rank" in out.columns:
            return {"content": engine.encoded(out, verbosity)}
        from lodestrata.operators.encoding import encode

        return {"content": encode({"results": [{k: v if isinstance(v, (str, int, float, bool)) or v is None else str(v) for k, v in r.asDict().items()} for r in out.collect()]})}
    except (TypeError, ValueError, LookupError) as e:
        return {"error": str(e)}
