"""Most similar vectors: vantage-point trees per shard, with relaxed pruning.

Angles are a metric on unit vectors, so a vantage point v and a radius r prune
a half of a tree by the triangle inequality: what lies within r of a query q
has a distance to v within r of d(q, v). In many dimensions that bound is far
too careful, because a step of length r seldom points straight at v. The
search therefore prunes at ``factor * r``; factor 1 restores exact search.

A routing tree, fitted for each (model, dimension) on a bounded sample, sends
every vector to one shard; its depth follows the number of rows, so a group
that holds most of the rows has more shards, not larger ones. A query goes to
its own shard and to those beyond a boundary that it lies near to. Each shard
grows its own vantage-point tree in memory and answers its queries by batches.
For pairs within a radius either vector may find the other, which squares the
chance of a miss away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import cut

#: Rows of each group from which its routing tree is fitted, at most. All rows are indexed.
FIT_ROWS = 4096
#: Rows that a shard should have, about.
SHARD_ROWS = 16_384
#: Below so many rows a tree's node is searched as a block.
LEAF_ROWS = 256
#: Pruning factor for pairs within a radius, where both sides search.
PAIR_FACTOR = 0.15
#: Pruning factor for the k nearest, where only the query searches.
TOPK_FACTOR = 0.35
KEY = "vector_key"


@dataclass
class Router:
    """A vantage-point tree as arrays; leaves are shards."""

    points: list = field(default_factory=list)
    bounds: list = field(default_factory=list)
    children: list = field(default_factory=list)
    shards: int = 1


def angles(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ point, -1.0, 1.0))


def _vantage(x: np.ndarray) -> int:
    """The row that lies farthest from the mean direction: it spreads the others' distances most. Ties: the first."""
    return int(np.argmin(x @ x.mean(axis=0)))


def fit_router(x: np.ndarray, depth: int) -> Router:
    """A routing tree of at most 2^depth shards. Where rows can't be told apart, it stops."""
    router = Router()

    def grow(rows: np.ndarray, left: int) -> int:
        """Negative: a shard; else the place of an inner node."""
        if left and len(rows) >= 2:
            part = x[rows]
            point = part[_vantage(part)]
            d = angles(part, point)
            bound = float(np.median(d))
            near = d <= bound
            if near.all():
                near = d < bound
                bound = float(d[near].max()) if near.any() else bound
            if near.any() and not near.all():
                place = len(router.points)
                router.points.append(point)
                router.bounds.append(bound)
                router.children.append(None)
                router.children[place] = (grow(rows[near], left - 1), grow(rows[~near], left - 1))
                return place
        router.shards += 1
        return -(router.shards - 1)

    router.shards = 1
    grow(np.arange(len(x)), depth)
    router.shards -= 1
    return router


def route(router: Router, x: np.ndarray, slack: np.ndarray | float) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows of x that it concerns). With slack 0 every row goes to exactly one shard."""
    if not router.points:
        yield 0, np.arange(len(x))
        return
    slack = np.broadcast_to(np.asarray(slack, dtype=np.float32), (len(x),))
    stack = [(0, np.arange(len(x)))]
    while stack:
        place, rows = stack.pop()
        if not len(rows):
            continue
        if place < 0:
            yield -place - 1, rows
            continue
        d = angles(x[rows], router.points[place]) - router.bounds[place]
        low, high = router.children[place]
        stack.append((low, rows[d <= slack[rows]]))
        stack.append((high, rows[d > -slack[rows]]))


def search(x: np.ndarray, q: np.ndarray, radius: np.ndarray, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of x, cosines as a matrix) for the leaves that the queries reach."""
    slack = (radius * factor).astype(np.float32)
    stack = [(np.arange(len(x)), np.arange(len(q)))]
    while stack:
        rows, asks = stack.pop()
        if not len(rows) or not len(asks):
            continue
        if len(rows) > LEAF_ROWS and len(asks) > 8:
            part = x[rows]
            point = part[_vantage(part[:1024])]
            d = angles(part, point)
            bound = float(np.median(d))
            near = d <= bound
            if not near.all():
                away = angles(q[asks], point) - bound
                stack.append((rows[near], asks[away <= slack[asks]]))
                stack.append((rows[~near], asks[away > -slack[asks]]))
                continue
        for k in range(0, len(rows), 8192):
            block = rows[k : k + 8192]
            for j in range(0, len(asks), 1024):
                some = asks[j : j + 1024]
                yield some, block, q[some] @ x[block].T


def usable(rows: DataFrame, model: str = "model_id", dimension: str = "dimension", vector: str = "vector", key: str = "content_hash") -> DataFrame:
    """(model_id, dimension, vector_key, vector) of the rows that count.

    A row counts if key, model and dimension aren't null and its vector has
    exactly ``dimension`` elements, none null or not a number, not all zero.
    Equal rows collapse; other columns of ``rows`` aren't read.
    """
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) == F.col(dimension)) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0)
    return rows.filter(F.col(key).isNotNull() & F.col(model).isNotNull() & F.col(dimension).isNotNull() & fine).select(F.col(model).alias("model_id"), F.col(dimension).cast("int").alias("dimension"), F.col(key).cast("string").alias(KEY), v.cast("array<float>").alias("vector"))


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, membership) of the rows of ``usable``: rows of one vector are one class.

    A class is named by 128 bits of its vector's hash. Representatives have the
    columns of ``usable`` with that name as key; membership is (model_id,
    dimension, class, vector_key), without vectors. Copies collapse before the
    shuffle, so a class that holds most of the rows is no hot group.
    """
    part = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), "vector")), 16, "0")
    named = rows.withColumn("class", F.concat(part(1), part(2)))
    return named.select("model_id", "dimension", F.col("class").alias(KEY), "vector").distinct(), named.select("model_id", "dimension", "class", KEY).distinct()


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, one a row; all of one dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x.astype(np.float32)


def fit_routers(vectors: DataFrame, shard_rows: int = SHARD_ROWS, fit_rows: int = FIT_ROWS) -> dict[tuple, Router]:
    """A routing tree for each (model, dimension).

    Only the fit sees a sample, by the hash of the key: about ``fit_rows`` rows
    of each group, which is what comes to the driver. All rows are indexed.
    """
    group = ["model_id", "dimension"]
    counts = {(r["model_id"], r["dimension"]): r["n"] for r in vectors.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    deep = {g: max(0, math.ceil(math.log2(n / shard_rows))) for g, n in counts.items()}
    share = F.lit(1.0)
    for (model, dimension), n in counts.items():
        share = F.when((F.col("model_id") == model) & (F.col("dimension") == dimension), F.lit(min(1.0, fit_rows / n) if deep[model, dimension] else 0.0)).otherwise(share)
    sample = vectors.filter((F.pmod(F.xxhash64(F.lit(7), KEY), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share)
    rows = sample.toArrow() if any(deep.values()) else None
    out = {}
    for (model, dimension), depth in deep.items():
        x = None
        if depth:
            mine = rows.filter(pc.and_(pc.equal(rows["model_id"], model), pc.equal(rows["dimension"], dimension)))
            order = np.argsort(np.array(mine[KEY].to_pylist()), kind="stable")
            x = _matrix(mine["vector"])[order] if len(mine) else None
        out[model, dimension] = fit_router(x, depth) if x is not None else Router()
    return out


def _routed(vectors: DataFrame, routers: dict, slack: Column | None, factor: float) -> DataFrame:
    """The rows of ``vectors`` with their shard, and ``own``: whether it's the shard they are stored in.

    Without slack each row comes once; with it, once for each shard within
    ``factor * slack`` of it.
    """
    plain = vectors if slack is None else vectors.withColumn("radius", slack.cast("float"))
    schema = T.StructType([*plain.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("own", T.BooleanType())])
    handle, spread = vectors.sparkSession.sparkContext.broadcast(routers), slack is not None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = handle.value
        for batch in batches:
            t = pa.Table.from_batches([batch])
            models, dims = t["model_id"].to_pylist(), t["dimension"].to_pylist()
            for group in sorted(set(zip(models, dims))):
                mine = t.take(pa.array([i for i, g in enumerate(zip(models, dims)) if g == group]))
                router, x = known[group], _matrix(mine["vector"])
                home = np.zeros(len(x), dtype=np.int32)
                for shard, rows in route(router, x, 0.0):
                    home[rows] = shard
                if not spread:
                    parts = [(home, np.arange(len(x)))]
                else:
                    parts = [(np.full(len(rows), shard, dtype=np.int32), rows) for shard, rows in route(router, x, mine["radius"].to_numpy() * np.float32(factor))]
                for shard, rows in parts:
                    yield from mine.take(pa.array(rows)).append_column("shard", pa.array(shard, pa.int32())).append_column("own", pa.array(home[rows] == shard)).to_batches(2000)

    return plain.mapInArrow(send, schema)


def similar_pairs(vectors: DataFrame, least_cosine: float, factor: float = PAIR_FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(model_id, dimension, key_a, key_b, cosine): pairs of distinct vectors with a cosine of ``least_cosine`` or more.

    ``vectors`` has one row a vector (see ``classes``). key_a < key_b; a pair
    comes out once. No bound on a vector's partners. Each vector is stored in
    one shard and asks in the few shards that the relaxed bound can't exclude.
    """
    routers = fit_routers(vectors, shard_rows)
    radius = float(math.acos(min(1.0, max(-1.0, least_cosine))))
    asked = _routed(vectors, routers, F.lit(radius), factor)
    schema = "model_id string, dimension int, key_a string, key_b string, cosine double"

    def shard(frame: pa.Table) -> pa.Table:
        own = np.array(frame["own"].to_pylist(), dtype=bool)
        q, keys = _matrix(frame["vector"]), np.array(frame[KEY].to_pylist(), dtype=object)
        at = np.flatnonzero(own)
        a, b, c = [], [], []
        for asks, rows, cosines in search(q[at], q, np.full(len(q), radius), factor):
            i, j = np.nonzero(cosines >= least_cosine - 1e-6)
            left, right = asks[i], at[rows[j]]
            differ = left != right
            a.append(left[differ])
            b.append(right[differ])
            c.append(cosines[i, j][differ])
        a, b = (np.concatenate(x) if x else np.empty(0, dtype=int) for x in (a, b))
        c = np.concatenate(c).astype(float) if c else np.empty(0)
        ka, kb = keys[a], keys[b]
        swap = np.array([x > y for x, y in zip(ka, kb)], dtype=bool)
        first, second = np.where(swap, kb, ka), np.where(swap, ka, kb)
        seen: dict = {}
        for x, y, z in zip(first, second, c):
            seen[x, y] = z
        n = len(seen)
        model, dimension = (frame["model_id"][0].as_py(), frame["dimension"][0].as_py()) if len(frame) else ("", 0)
        return pa.table({"model_id": pa.array([model] * n, pa.string()), "dimension": pa.array([dimension] * n, pa.int32()), "key_a": pa.array([k[0] for k in seen], pa.string()), "key_b": pa.array([k[1] for k in seen], pa.string()), "cosine": pa.array(list(seen.values()), pa.float64())})

    pairs = asked.groupBy("model_id", "dimension", "shard").applyInArrow(shard, schema)
    return pairs.groupBy("model_id", "dimension", "key_a", "key_b").agg(F.max("cosine").alias("cosine"))


def most_similar(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = TOPK_FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(model_id, dimension, query_key, rank, vector_key, cosine): the k nearest of each query among ``vectors``.

    Both have the columns of ``usable``. A key isn't its own neighbour; ties in
    cosine go by key; fewer than k come out only where a group has fewer. The
    first round asks in the query's own shard and gives it a radius, the second
    asks in all shards within ``factor`` times that radius.
    """
    routers = fit_routers(vectors, shard_rows)
    group = ["model_id", "dimension"]
    stored = _routed(vectors, routers, None, 0.0).select(*group, "shard", KEY, "vector", F.lit(None).cast("float").alias("radius"), F.lit(False).alias("is_query"))
    out = "model_id string, dimension int, query_key string, vector_key string, cosine double, found int"

    def ask(frame: pa.Table) -> pa.Table:
        is_query = np.array(frame["is_query"].to_pylist(), dtype=bool)
        x, keys = _matrix(frame["vector"]), np.array(frame[KEY].to_pylist(), dtype=object)
        at, asking = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        radius = np.array([math.pi / factor if r is None else r for r in frame["radius"].to_pylist()], dtype=np.float32)[asking]
        bound = np.full(len(asking), -2.0, dtype=np.float32)
        hits: list[tuple] = []
        for asks, rows, cosines in search(x[at], x[asking], radius, factor):
            if len(rows) > k + 1:
                bound[asks] = np.maximum(bound[asks], -np.partition(-cosines, k, axis=1)[:, k])
            i, j = np.nonzero(cosines >= bound[asks][:, None])
            hits.append((asks[i], rows[j], cosines[i, j]))
        ask_at, row_at, cosine = (np.concatenate(c) for c in zip(*hits)) if hits else (np.empty(0, int), np.empty(0, int), np.empty(0))
        stays = cosine >= bound[ask_at]
        ask_at, row_at, cosine = ask_at[stays], row_at[stays], cosine[stays].astype(float)
        q, v = keys[asking[ask_at]], keys[at[row_at]]
        best = pd.DataFrame({"query_key": q, "vector_key": v, "cosine": cosine})
        best = best[best["query_key"] != best["vector_key"]].sort_values(["query_key", "cosine", "vector_key"], ascending=[True, False, True]).drop_duplicates(["query_key", "vector_key"])
        best = best.groupby("query_key", sort=False).head(k)
        n = len(best)
        model, dimension = frame["model_id"][0].as_py(), frame["dimension"][0].as_py()
        return pa.table({"model_id": pa.array([model] * n, pa.string()), "dimension": pa.array([dimension] * n, pa.int32()), "query_key": pa.array(best["query_key"].tolist(), pa.string()), "vector_key": pa.array(best["vector_key"].tolist(), pa.string()), "cosine": pa.array(best["cosine"].to_numpy(), pa.float64()), "found": pa.array(best.groupby("query_key")["cosine"].transform("size").astype("int32").to_numpy() if n else [], pa.int32())})

    def asked(routed: DataFrame) -> DataFrame:
        both = stored.unionByName(routed.select(*group, "shard", KEY, "vector", F.col("radius").cast("float").alias("radius"), F.lit(True).alias("is_query")))
        return both.groupBy(*group, "shard").applyInArrow(ask, out)

    everywhere = F.lit(math.pi / factor)
    own = _routed(queries, routers, None, 0.0).withColumn("radius", everywhere)
    known = cut(asked(own).groupBy(*group, F.col("query_key").alias(KEY)).agg(F.min("cosine").alias("least"), F.max("found").alias("found")))
    reach = F.when(F.col("found") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least"))))).otherwise(everywhere)
    wide = queries.join(known, [*group, KEY], "left").select(*group, KEY, "vector", F.coalesce(reach, everywhere).alias("reach"))
    hits = asked(_routed(wide, routers, F.col("reach"), factor)).dropDuplicates([*group, "query_key", "vector_key"])
    by = Window.partitionBy(*group, "query_key").orderBy(F.desc("cosine"), "vector_key")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select(*group, "query_key", "rank", "vector_key", "cosine")


def found_pairs(embedding_cache: DataFrame, least_cosine: float = 0.92, factor: float = PAIR_FACTOR) -> DataFrame:
    """Distinct (model_id, hash_a, hash_b), hash_a < hash_b, of one model and dimension and a cosine of 0.92 or more.

    Pairs of classes are found by the trees, then spread to the hashes of both;
    the hashes of one class are pairs by themselves.
    """
    group = ["model_id", "dimension"]
    reps, members = classes(usable(embedding_cache))
    pairs = similar_pairs(cut(reps), least_cosine, factor).select(*group, F.col("key_a").alias("class_a"), F.col("key_b").alias("class_b"))
    many = members.groupBy(*group, "class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*group, F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    of = lambda side: members.select(*group, F.col("class").alias(f"class_{side}"), F.col(KEY).alias(f"hash_{side}"))
    both = pairs.unionByName(many).join(of("a"), [*group, "class_a"]).join(of("b"), [*group, "class_b"])
    differ = both.filter(F.col("hash_a") != F.col("hash_b")).filter((F.col("class_a") != F.col("class_b")) | (F.col("hash_a") < F.col("hash_b")))
    return differ.select("model_id", F.least("hash_a", "hash_b").alias("hash_a"), F.greatest("hash_a", "hash_b").alias("hash_b")).distinct()


def similar_queries(rows: DataFrame) -> DataFrame:
    """The stated query set: each usable row whose key's CRC-32 is divisible by 100 (keys aren't numbers here)."""
    return rows.filter(F.crc32(F.col(KEY).cast("binary")) % 100 == 0)
