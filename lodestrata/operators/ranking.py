"""Ranked lists: fusing, merging, penalising, ordering. Order is a column, ``rank`` (from 0) or ``score``; every tie goes by node_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The parameters of ranking and their defaults.
DEFAULTS = {
    "rrf_k": 60, "lexical_limit": 100, "name_weight": 10.0, "body_weight": 1.0, "blog_penalty": 0.85, "world_penalty": 0.5, "near_dup_penalty": 0.5, "near_dup_jaccard": 0.8, "delegate_penalty": 1.0,
    "expansion_discount": 0.4, "min_seed_score": 0.5, "min_result_score": 0.35, "per_seed_cap": 3, "score_floor": 0.70, "gamedata_limit": 200, "snippet_max": 1500, "rerank_top": 50,
}
#: Data types of the world at large, which rank lower.
WORLD_TYPES = ("cave", "prefab", "zone", "worldgen", "instance", "terrain_layer", "environment", "biome")


def rrf(lists: DataFrame, k: int = 60, normalised: bool = True, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, node_id, score, first_list): reciprocal rank fusion.

    ``lists`` has the keys, list_no, rank from 0 and node_id. Each row counts
    1/(k+rank+1), also if a node is in a list twice; ``normalised`` divides by
    the best of the key.
    """
    fused = lists.groupBy(*keys, "node_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)).alias("score"), F.min("list_no").alias("first_list"))
    if not normalised:
        return fused
    return fused.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(*keys)))


def top(ranked: DataFrame, limit: int, keys: tuple[str, ...] = ("query_id",), order: list[Column] | None = None) -> DataFrame:
    """The best ``limit`` of each key with their rank from 0, by score and then node_id unless ``order`` says else."""
    by = Window.partitionBy(*keys).orderBy(*(order or [F.desc("score"), F.asc("node_id")]))
    return ranked.withColumn("rank", F.row_number().over(by) - 1).filter(F.col("rank") < limit)


def merge_duplicates(results: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Each node once, at its best score and first position; a null provenance is filled from the next best row that has one.

    ``results`` has the keys, pos, node_id, score, bridged_from and bridge_type.
    """
    by = Window.partitionBy(*keys, "node_id").orderBy(F.desc("score"), "pos")
    best = results.withColumn("n", F.row_number().over(by))
    fill = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("n", c))).getField(c).alias(c)
    return best.groupBy(*keys, "node_id").agg(F.max("score").alias("score"), F.min("pos").alias("pos"), fill("bridged_from"), fill("bridge_type"))


def penalised(score: Column, corpus: Column, node_id: Column, data_type: Column, blog: float = 0.85, world: float = 0.5) -> Column:
    """Scores of docs from a blog and of gamedata of the world at large, lowered."""
    docs = F.when((corpus == "docs") & node_id.startswith("blog:"), F.lit(blog)).otherwise(1.0)
    game = F.when((corpus == "gamedata") & data_type.isin(*WORLD_TYPES), F.lit(world)).otherwise(1.0)
    return score * docs * game


def recency_order(date: Column, score: Column) -> list[Column]:
    """Newest first, undated last, then by score."""
    return [F.coalesce(date, F.lit("")).desc(), score.desc()]


def diversify(results: DataFrame, near_dup: float = 0.5, jaccard: float = 0.8, delegate: float = 1.0, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Near duplicates of better results, lowered: of the same method name, or with snippets that share 0.8 of their words.

    ``results`` has the keys, node_id, display_name, snippet, thin and score.
    The walk is greedy and so goes through a key's results in one piece, which
    the candidate limits of a search bound (hundreds of rows a query).
    """
    if near_dup >= 1 and delegate >= 1:
        return results
    schema = results.schema

    def walk(pdf):
        import re

        pdf = pdf.sort_values(["score", "node_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        kept: list[tuple[str, set]] = []
        scores = []
        for row in pdf.itertuples(index=False):
            label = row.display_name if isinstance(row.display_name, str) and "#" in row.display_name else row.node_id
            name = label.rsplit("#", 1)[1] if isinstance(label, str) and "#" in label else None
            words = set(w.lower() for w in re.findall(r"\w+", row.snippet or "")) if isinstance(row.snippet, str) else set()
            score = row.score
            if name is not None:
                if any(name == n or (words and w and len(words & w) / len(words | w) >= jaccard) for n, w in kept):
                    score *= near_dup
                else:
                    kept.append((name, words))
            scores.append(score * (delegate if bool(row.thin) else 1.0))
        pdf["score"] = scores
        return pdf

    return results.groupBy(*keys).applyInPandas(walk, schema)


def rerank(results: DataFrame, order: DataFrame, limit: int = 50, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """A reranker's order put upon the best ``limit`` results.

    ``order`` has the keys, pos (of the result, from 0), place (from 0) and
    relevance. What it names comes first with score 1 - place/n; what it
    doesn't name keeps its order behind, without relevance.
    """
    n = Window.partitionBy(*keys)
    joined = results.join(order, [*keys, "pos"], "left").withColumn("named", F.count("place").over(n))
    key = F.when(F.col("place").isNotNull() & (F.col("pos") < limit), F.col("place")).otherwise(F.col("pos") + 1_000_000)
    by = Window.partitionBy(*keys).orderBy("sort_key")
    out = joined.withColumn("sort_key", key).withColumn("new_pos", F.row_number().over(by) - 1)
    return out.withColumn("score", F.when(F.col("place").isNotNull(), 1 - F.col("place") / F.col("named")).otherwise(F.col("score"))).drop("sort_key", "named", "place", "pos").withColumnRenamed("new_pos", "pos")


def expand(seeds: DataFrame, links: DataFrame, discount: float = 0.4, min_seed: float = 0.5, min_result: float = 0.35, cap: int = 3, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, node_id, score, bridged_from, bridge_type): what the seeds' bridges lead to, best seed first, each node once.

    ``seeds`` has the keys, node_id and score; ``links`` (seed_id, node_id,
    edge_type, seq). A seed gives ``cap`` nodes at most; a node that is a seed
    isn't given again.
    """
    good = seeds.filter(F.col("score") >= min_seed).select(*keys, F.col("node_id").alias("seed_id"), F.col("score").alias("seed_score"))
    hits = good.join(links, "seed_id").join(seeds.select(*keys, "node_id"), [*keys, "node_id"], "left_anti")
    first = Window.partitionBy(*keys, "node_id").orderBy(F.desc("seed_score"), "seed_id", "seq")
    once = hits.withColumn("n", F.row_number().over(first)).filter("n = 1")
    per_seed = Window.partitionBy(*keys, "seed_id").orderBy("seq", "node_id")
    capped = once.withColumn("m", F.row_number().over(per_seed)).filter(F.col("m") <= cap)
    return capped.select(*keys, "node_id", (F.col("seed_score") * discount).alias("score"), F.col("seed_id").alias("bridged_from"), F.col("edge_type").alias("bridge_type")).filter(F.col("score") >= min_result)
