"""Quality of retrieval: recall, reciprocal rank, gain, sweeps of parameters."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(golden: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(query_id, first_hit, recall_at_k ..., mrr, ndcg): how early the first expected id comes.

    ``golden`` has (query_id, expected), ``ranked`` (query_id, rank from 0,
    node_id). An id hits if it holds an expected one, without case. A query
    without hit or results scores 0.
    """
    hits = golden.join(ranked, "query_id").filter(F.expr("contains(lower(node_id), lower(expected))")).groupBy("query_id").agg((F.min("rank") + 1).alias("first_hit"))
    all_ = golden.select("query_id").distinct().join(hits, "query_id", "left")
    recall = {f"recall_at_{k}": F.when(F.col("first_hit") <= k, 1.0).otherwise(0.0) for k in ks}
    return all_.withColumns(recall | {"mrr": F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)), "ndcg": F.coalesce(1.0 / F.log2(F.col("first_hit") + 1), F.lit(0.0))})


def mean_metrics(metrics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over queries (not over means of groups)."""
    names = [c for c in metrics.columns if c.startswith("recall_at_") or c in ("mrr", "ndcg")]
    return metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_queries"), *(F.avg(c).alias(c) for c in names))


def passes(mean_recall_at_5: float, baseline: float | None) -> bool:
    return baseline is None or mean_recall_at_5 >= baseline


def sweep_grid(axes: dict[str, list]) -> list[dict]:
    """Every combination of the axes' values, the last axis changing fastest; one empty combination without axes."""
    return [dict(zip(axes, values)) for values in product(*axes.values())]


def best_combination(means: DataFrame) -> DataFrame:
    """The first combination with the greatest recall_at_5 * 1000 + mrr; ``means`` has combo, recall_at_5 and mrr."""
    by = Window.orderBy(F.desc(F.col("recall_at_5") * 1000 + F.col("mrr")), "combo")
    return means.withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")
