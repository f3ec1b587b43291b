"""Traversals of the typed graph, for whole tables of seeds at once.

``seeds`` has (slug, seed_id); one plan answers for all of them. Edges are
unique by source, target and type, of which the first by id holds. Limits are
per seed, in order of the edge's id and then the node's; Spark applies them
before the shuffle, so a hub doesn't fill one task. Virtual targets have no
node and drop out of joins with nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut

NODE_COLUMNS = ("node_type", "display_name", "corpus")


def unique_edges(edges: DataFrame) -> DataFrame:
    """(slug, source_id, target_id, edge_type, seq): each relation once, ``seq`` being its first id.

    Edges without source, target or type don't count.
    """
    known = edges.filter("source_id is not null and target_id is not null and edge_type is not null")
    return known.groupBy("slug", "source_id", "target_id", "edge_type").agg(F.min("id").alias("seq"))


def node_heads(nodes: DataFrame, *more: str) -> DataFrame:
    """(slug, id, node_type, display_name, corpus, ...), each node once."""
    return nodes.filter("id is not null").select("slug", "id", *NODE_COLUMNS, *more).dropDuplicates(["slug", "id"])


def all_seeds(nodes: DataFrame, condition: Column | None = None) -> DataFrame:
    """Every node as a seed, or those of a condition."""
    rows = nodes if condition is None else nodes.filter(condition)
    return rows.filter("id is not null").select("slug", F.col("id").alias("seed_id")).distinct()


def _ranked(hits: DataFrame, limit: int | None) -> DataFrame:
    by = Window.partitionBy("slug", "seed_id").orderBy("seq", "node_id")
    ranked = hits.withColumn("rank", F.row_number().over(by))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def neighbours(edges: DataFrame, nodes: DataFrame, edge_types: list[str], outgoing: bool, seeds: DataFrame | None = None, condition: Column | None = None, limit: int | None = 10) -> DataFrame:
    """(slug, seed_id, node_id, edge_type, node_type, display_name, corpus, rank): nodes one edge away.

    ``condition`` is on the neighbour's node_type, display_name and corpus.
    Without seeds, every end of such an edge is one.
    """
    here, there = ("source_id", "target_id") if outgoing else ("target_id", "source_id")
    kept = unique_edges(edges.filter(F.col("edge_type").isin(edge_types)))
    hits = kept.select("slug", F.col(here).alias("seed_id"), F.col(there).alias("node_id"), "edge_type", "seq")
    if seeds is not None:
        hits = hits.join(seeds.select("slug", "seed_id").distinct(), ["slug", "seed_id"], "left_semi")
    heads = node_heads(nodes).withColumnRenamed("id", "node_id")
    found = hits.join(heads if condition is None else heads.filter(condition), ["slug", "node_id"])
    return _ranked(found, limit).select("slug", "seed_id", "node_id", "edge_type", *NODE_COLUMNS, "rank")


def class_of(node_id: Column) -> Column:
    """The class id a method or class id belongs to: ``class:`` and what stands before #."""
    bare = F.regexp_replace(F.substring_index(node_id, "#", 1), "^class:", "")
    return F.concat(F.lit("class:"), bare)


def callers(edges: DataFrame, nodes: DataFrame, limit: int | None = 10) -> DataFrame:
    """(slug, seed_id, node_id, display_name, rank): what calls each seed.

    Seeds are all code nodes. A call of a class counts for the class's methods
    that have no calls of their own name in it, that is for a seed in either
    form; for a seed that is a class, calls of any of its members count too.
    """
    calls = unique_edges(edges.filter("edge_type = 'CALLS'"))
    seeds = all_seeds(nodes, F.col("corpus") == "code")
    own = seeds.select("slug", "seed_id", F.col("seed_id").alias("target_id"))
    form = seeds.filter(~F.col("seed_id").startswith("class:")).select("slug", "seed_id", class_of(F.col("seed_id")).alias("target_id"))
    members = calls.filter(F.instr("target_id", "#") > 0).select("slug", class_of(F.col("target_id")).alias("seed_id"), "target_id").distinct().join(seeds.filter(F.col("seed_id").startswith("class:")), ["slug", "seed_id"], "left_semi")
    reach = own.unionByName(form).unionByName(members).distinct()
    hits = reach.join(calls, ["slug", "target_id"]).groupBy("slug", "seed_id", F.col("source_id").alias("node_id")).agg(F.min("seq").alias("seq"))
    return _ranked(hits.join(node_heads(nodes).withColumnRenamed("id", "node_id"), ["slug", "node_id"]), limit).select("slug", "seed_id", "node_id", "display_name", "rank")


def callees(edges: DataFrame, nodes: DataFrame, limit: int | None = 10) -> DataFrame:
    """(slug, seed_id, node_id, display_name, rank): what each seed calls; a method without node falls back to its class."""
    calls = unique_edges(edges.filter("edge_type = 'CALLS'"))
    heads = node_heads(nodes).select("slug", "id", "display_name")
    a, b = heads.alias("a"), heads.alias("b")
    both = calls.alias("c").join(a, (F.col("c.slug") == F.col("a.slug")) & (F.col("c.target_id") == F.col("a.id")), "left").join(b, (F.col("c.slug") == F.col("b.slug")) & (class_of(F.col("c.target_id")) == F.col("b.id")), "left")
    hits = both.select("c.slug", F.col("c.source_id").alias("seed_id"), F.coalesce("a.id", "b.id").alias("node_id"), F.coalesce("a.display_name", "b.display_name").alias("display_name"), "c.seq").filter("node_id is not null")
    once = hits.groupBy("slug", "seed_id", "node_id", "display_name").agg(F.min("seq").alias("seq"))
    return _ranked(once, limit).select("slug", "seed_id", "node_id", "display_name", "rank")


def both_ways(edges: DataFrame, nodes: DataFrame, edge_type: str, limit: int | None = 10) -> DataFrame:
    """(slug, seed_id, node_id, score): outgoing neighbours at 1.0 and incoming ones at 0.9, each node once at its best."""
    out = neighbours(edges, nodes, [edge_type], True, limit=limit).select("slug", "seed_id", "node_id", F.lit(1.0).alias("score"))
    into = neighbours(edges, nodes, [edge_type], False, limit=limit).select("slug", "seed_id", "node_id", F.lit(0.9).alias("score"))
    return out.unionByName(into).groupBy("slug", "seed_id", "node_id").agg(F.max("score").alias("score"))


def two_hops(edges: DataFrame, nodes: DataFrame, first: str, second: str, limit: int | None = 10) -> DataFrame:
    """(slug, seed_id, node_id, display_name, rank): nodes two edges of given types away, by the way of anything."""
    a = unique_edges(edges.filter(F.col("edge_type") == first)).select("slug", F.col("source_id").alias("seed_id"), F.col("target_id").alias("via"), F.col("seq").alias("seq_a"))
    b = unique_edges(edges.filter(F.col("edge_type") == second)).select("slug", F.col("source_id").alias("via"), F.col("target_id").alias("node_id"), F.col("seq").alias("seq_b"))
    hits = a.join(b, ["slug", "via"]).groupBy("slug", "seed_id", "node_id").agg(F.min(F.struct("seq_a", "seq_b")).alias("seq"))
    return _ranked(hits.join(node_heads(nodes).withColumnRenamed("id", "node_id"), ["slug", "node_id"]), limit).select("slug", "seed_id", "node_id", "display_name", "rank")


def node_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(slug, seed_id, direction, edge_type, other_id, other_name): all edges of each node, dangling ends with a null name."""
    kept = unique_edges(edges)
    sides = F.explode(F.array(F.struct(F.lit("out").alias("direction"), F.col("source_id").alias("seed_id"), F.col("target_id").alias("other_id")), F.struct(F.lit("in").alias("direction"), F.col("target_id").alias("seed_id"), F.col("source_id").alias("other_id")))).alias("x")
    long = kept.select("slug", "edge_type", sides).select("slug", "x.direction", "x.seed_id", "edge_type", "x.other_id").join(all_seeds(nodes), ["slug", "seed_id"], "left_semi")
    names = node_heads(nodes).select("slug", F.col("id").alias("other_id"), F.col("display_name").alias("other_name"))
    return long.join(names, ["slug", "other_id"], "left").select("slug", "seed_id", "direction", "edge_type", "other_id", "other_name")


def related(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, edge_types: list[str] | None = None, direction: str = "both", depth: int = 3, limit: int | None = None) -> DataFrame:
    """(slug, seed_id, node_id, depth, edge_type): what a breadth-first walk of up to 3 steps finds.

    edge_type is that of the first discovery, least by edge id; a seed isn't
    related to itself; virtual ends are neither given nor walked on from.
    ``direction`` is up (along edges), down (against them) or both.
    """
    if not 1 <= depth <= 3 or direction not in ("up", "down", "both"):
        raise ValueError("depth must be from 1 to 3, direction up, down or both")
    kept = unique_edges(edges if edge_types is None else edges.filter(F.col("edge_type").isin(edge_types)))
    real = node_heads(nodes).select("slug", F.col("id").alias("node_id"))
    parts = []
    if direction != "down":
        parts.append(kept.select("slug", F.col("source_id").alias("at"), F.col("target_id").alias("node_id"), "edge_type", "seq"))
    if direction != "up":
        parts.append(kept.select("slug", F.col("target_id").alias("at"), F.col("source_id").alias("node_id"), "edge_type", "seq"))
    steps = cut(reduce(DataFrame.unionByName, parts).join(real, ["slug", "node_id"], "left_semi").select("slug", "at", "node_id", "edge_type", "seq"))
    seeds = seeds.select("slug", "seed_id").distinct()
    seen = seeds.select("slug", "seed_id", F.col("seed_id").alias("node_id"))
    frontier, found = seen.withColumnRenamed("node_id", "at"), []
    for level in range(1, depth + 1):
        new = frontier.join(steps, ["slug", "at"]).join(seen, ["slug", "seed_id", "node_id"], "left_anti")
        first = new.groupBy("slug", "seed_id", "node_id").agg(F.min(F.struct("seq", "edge_type")).alias("first"))
        first = cut(first.select("slug", "seed_id", "node_id", F.lit(level).alias("depth"), F.col("first.edge_type").alias("edge_type"), F.col("first.seq").alias("seq")))
        found.append(first)
        seen = seen.unionByName(first.select("slug", "seed_id", "node_id"))
        frontier = first.select("slug", "seed_id", F.col("node_id").alias("at"))
    out = reduce(DataFrame.unionByName, found)
    if limit is not None:
        by = Window.partitionBy("slug", "seed_id").orderBy("depth", "seq", "node_id")
        out = out.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= limit)
    return out.select("slug", "seed_id", "node_id", "depth", "edge_type")


def by_relation(edges: DataFrame, nodes: DataFrame, names: DataFrame, edge_type: str) -> DataFrame:
    """(slug, name, node_id, score): sources whose edge leads to the class of that name, at 1.0; only if there are none, targets of edges from it, at 0.9.

    ``names`` has (slug, name), simple class names, compared without case.
    """
    kept = unique_edges(edges.filter(F.col("edge_type") == edge_type))
    simple = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.substring_index(c, "#", 1), "^class:", ""), r"^.*\.", ""))
    asked = names.select("slug", "name", F.lower("name").alias("key")).distinct()
    real = node_heads(nodes).select("slug", F.col("id").alias("node_id"))
    into = kept.filter(F.col("target_id").startswith("class:") & (F.instr("target_id", "#") == 0)).select("slug", simple(F.col("target_id")).alias("key"), F.col("source_id").alias("node_id"))
    forward = asked.join(into, ["slug", "key"]).join(real, ["slug", "node_id"], "left_semi").select("slug", "name", "node_id", F.lit(1.0).alias("score")).distinct()
    rest = asked.join(forward.select("slug", "name").distinct(), ["slug", "name"], "left_anti")
    out = kept.filter(F.col("source_id").startswith("class:") & (F.instr("source_id", "#") == 0)).select("slug", simple(F.col("source_id")).alias("key"), F.col("target_id").alias("node_id"))
    back = rest.join(out, ["slug", "key"]).join(real, ["slug", "node_id"], "left_semi").select("slug", "name", "node_id", F.lit(0.9).alias("score")).distinct()
    return forward.unionByName(back)


def resolve_ids(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(slug, ref, resolution, node_id, n_candidates): exact id, else the only node of that name or with that last part.

    ``refs`` has (slug, ref). More than one candidate is ambiguous and gives
    the least id; none gives no node. An exact id wins over names.
    """
    heads = node_heads(nodes).select("slug", "id", "display_name", F.regexp_extract("id", r"\.([^.]*)$", 1).alias("tail"))
    asked = refs.select("slug", "ref").distinct()
    exact = asked.join(heads.select("slug", F.col("id").alias("ref")), ["slug", "ref"], "left_semi").select("slug", "ref", F.lit("exact").alias("resolution"), F.col("ref").alias("node_id"), F.lit(1).cast("bigint").alias("n_candidates"))
    keys = heads.select("slug", "id", F.explode(F.array_distinct(F.array("display_name", "tail"))).alias("ref")).filter("ref is not null and ref <> ''")
    rest = asked.join(exact.select("slug", "ref"), ["slug", "ref"], "left_anti")
    found = rest.join(keys, ["slug", "ref"], "left").groupBy("slug", "ref").agg(F.count("id").alias("n_candidates"), F.min("id").alias("node_id"))
    kind = F.when(F.col("n_candidates") == 1, "name").when(F.col("n_candidates") > 1, "ambiguous").otherwise("none")
    return exact.unionByName(found.select("slug", "ref", kind.alias("resolution"), "node_id", "n_candidates"))


def name_suggestions(nodes: DataFrame, part: str, limit: int = 10) -> DataFrame:
    """(slug, id, display_name, rank): nodes whose name or id holds ``part`` (ILIKE), shortest names first, per slug."""
    pattern = "%" + part.replace("\\", "\\\\") + "%"
    heads = node_heads(nodes).filter(F.col("display_name").ilike(pattern) | F.col("id").ilike(pattern))
    by = Window.partitionBy("slug").orderBy(F.length("display_name"), "id")
    return heads.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit).select("slug", "id", "display_name", "rank")


def class_methods(edges: DataFrame, nodes: DataFrame, limit_depth: int = 3) -> DataFrame:
    """(slug, class_id, node_id, signature, inherited_from, depth): each class's methods, its own and those it inherits.

    A method is hidden by one of the same signature (name and parameter types
    from its metadata) nearer to the class; overloads stay apart. Classes are
    searched along EXTENDS and IMPLEMENTS, up to ``limit_depth`` steps.
    """
    heads = node_heads(nodes, "line_start", "metadata")
    methods = heads.filter(F.instr("id", "#") > 0)
    params = F.coalesce(F.get_json_object("metadata", "$.params[*].type.base"), F.lit(""))
    name = F.regexp_replace(F.substring_index("id", "#", -1), r"~\d+$", "")
    own = methods.select("slug", class_of(F.col("id")).alias("owner"), F.col("id").alias("node_id"), F.concat(name, F.lit("("), params, F.lit(")")).alias("signature"), "line_start")
    classes = heads.filter(F.col("id").startswith("class:")).select("slug", F.col("id").alias("seed_id")).distinct()
    above = related(edges, nodes, classes, ["EXTENDS", "IMPLEMENTS"], "up", limit_depth).select("slug", F.col("seed_id").alias("class_id"), F.col("node_id").alias("owner"), "depth")
    owners = classes.select("slug", F.col("seed_id").alias("class_id"), F.col("seed_id").alias("owner"), F.lit(0).alias("depth")).unionByName(above)
    held = owners.join(own, ["slug", "owner"]).withColumn("n", F.dense_rank().over(Window.partitionBy("slug", "class_id", "signature").orderBy("depth", "owner"))).filter("n = 1")
    return held.select("slug", "class_id", "node_id", "signature", F.when(F.col("depth") > 0, F.col("owner")).alias("inherited_from"), "depth")
