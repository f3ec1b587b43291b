"""Embedding back ends, batches, the cache, and exact nearest neighbours of a set of queries."""

from __future__ import annotations

import hashlib
import math
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import plan_bytes, staged

#: Queries that are sent to all tasks at once.
BLOCK = 4096
BROADCAST_BYTES = 64 << 20


class EmbeddingBackend(ABC):
    """What turns texts into vectors; documents and queries may differ."""

    name: str
    dimension: int

    @abstractmethod
    def embed(self, texts: list[str], purpose: str = "document") -> list[list[float]]: ...


class ConstantBackend(EmbeddingBackend):
    """All ones, for tests."""

    def __init__(self, dimension: int = 8) -> None:
        self.name, self.dimension = "constant", dimension

    def embed(self, texts: list[str], purpose: str = "document") -> list[list[float]]:
        return [[1.0] * self.dimension for _ in texts]


class HashingBackend(EmbeddingBackend):
    """Signed hashes of words, of unit length; a text without words is the first axis."""

    def __init__(self, dimension: int = 64) -> None:
        self.name, self.dimension = f"hashing-{dimension}", dimension

    def embed(self, texts: list[str], purpose: str = "document") -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1.0 if (h >> 40) & 1 else -1.0
            length = math.sqrt(sum(x * x for x in v))
            out.append([x / length for x in v] if length else [1.0, *[0.0] * (self.dimension - 1)])
        return out


class RemoteBackend(EmbeddingBackend):
    """A service behind a function that sends one batch; batches are capped and texts cut to what the service takes.

    A failure with ``retry_after`` waits that long, others 1, 2, 4 ... seconds;
    failures without hope (``fatal``) aren't tried again.
    """

    def __init__(self, name: str, dimension: int, send: Callable[[list[str], str], list[list[float]]], batch: int = 128, max_chars: int = 32_000, tries: int = 3, wait: Callable[[float], None] | None = None) -> None:
        import time

        self.name, self.dimension, self.send, self.batch, self.max_chars, self.tries, self.wait = name, dimension, send, batch, max_chars, tries, wait or time.sleep

    def embed(self, texts: list[str], purpose: str = "document") -> list[list[float]]:
        out: list[list[float]] = []
        for k in range(0, len(texts), self.batch):
            part = [t[: self.max_chars] for t in texts[k : k + self.batch]]
            for attempt in range(self.tries):
                try:
                    out.extend(self.send(part, purpose))
                    break
                except Exception as e:
                    if getattr(e, "fatal", False) or attempt == self.tries - 1:
                        raise
                    self.wait(getattr(e, "retry_after", None) or 2.0**attempt)
        return out


#: What services take: texts a batch, characters a text, default dimension.
SERVICES = {"openai": (128, 32_000, 1536), "jina": (128, 32_000, 1024), "mistral": (128, 32_000, 1024), "voyage": (128, 32_000, 1024), "cohere": (96, 32_000, 1024), "gemini": (100, 32_000, 768), "ollama": (10, 4_000, 768), "local": (32, 2_000, 384)}


def service(provider: str, send: Callable[[list[str], str], list[list[float]]], dimension: int | None = None) -> RemoteBackend:
    """A remote back end with the caps of a known provider; unknown ones are taken as ``openai``."""
    batch, chars, default = SERVICES.get(provider, SERVICES["openai"])
    return RemoteBackend(provider, dimension or default, send, batch, chars)


def embed_column(rows: DataFrame, text: str, backend: EmbeddingBackend, concurrency: int | None = None) -> DataFrame:
    """``rows`` with ``vector``: its texts embedded in Arrow batches; null texts have no vector.

    ``concurrency`` bounds how many tasks ask at once.
    """
    from pyspark.sql import types as T

    if concurrency:
        rows = rows.repartition(concurrency)
    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
    at = rows.columns.index(text)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            made = iter(backend.embed([t for t in texts if t is not None]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if t is None else next(made) for t in texts], pa.list_(pa.float32()))], [*batch.schema.names, "vector"])

    return rows.mapInArrow(walk, schema)


def embed_missing(texts: DataFrame, cache: DataFrame, text: str, backend: EmbeddingBackend) -> DataFrame:
    """New cache rows (content_hash, model_id, vector, dimension) for the distinct texts that the cache lacks; to be appended."""
    wanted = texts.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("content_hash"), F.col(text).alias("text")).dropDuplicates(["content_hash"])
    misses = wanted.join(cache.filter(F.col("model_id") == backend.name).select("content_hash"), "content_hash", "left_anti")
    return embed_column(misses, "text", backend).select("content_hash", F.lit(backend.name).alias("model_id"), "vector", F.lit(backend.dimension).alias("dimension"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", round_to: int | None = None) -> DataFrame:
    """(query_key, rank, key, score): the k vectors of greatest cosine for each query, exactly; ties by key.

    The queries are a stated set and go to the tasks in blocks of bounded size,
    one after the other if there are several; each task keeps its own best k of a query, so that k rows a query
    and task are shuffled. Vectors that are null, empty, zero or of another
    length than the query's don't count; a query isn't its own neighbour.
    """
    from functools import reduce

    usable = lambda df: df.filter(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))).select(key, F.col(vector).cast("array<double>").alias("v"))
    asked = usable(queries)
    kind = vectors.schema[key].dataType.simpleString()
    # an estimate may be far too high (of rows from the driver it is unbounded); then the bytes are counted
    nbytes = plan_bytes(queries)
    nbytes = nbytes if nbytes <= BROADCAST_BYTES else 8 * (asked.agg(F.sum(F.size("v"))).collect()[0][0] or 0)
    blocks = max(1, -(-nbytes // BROADCAST_BYTES))
    parts = []
    for block in range(blocks):
        rows = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == block)).toArrow()
        handle = vectors.sparkSession.sparkContext.broadcast((rows[key].to_pylist(), rows["v"].to_pylist()))

        def scan(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            keys, lists = handle.value
            best: dict = {}
            key_type = pa.string()
            by_length: dict[int, list[int]] = {}
            for i, q in enumerate(lists):
                by_length.setdefault(len(q), []).append(i)
            unit = {n: _unit(np.array([lists[i] for i in at])) for n, at in by_length.items()}
            for batch in batches:
                key_type = batch.schema.field(0).type
                mine, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for n, at in by_length.items():
                    have = [i for i, v in enumerate(vs) if len(v) == n]
                    if not have:
                        continue
                    x = _unit(np.array([vs[i] for i in have]))
                    for start in range(0, len(at), BLOCK):
                        cos = unit[n][start : start + BLOCK] @ x.T
                        for row, qi in enumerate(at[start : start + BLOCK]):
                            line = cos[row]
                            edge = np.partition(line, -(k + 1))[-(k + 1)] if len(line) > k + 1 else -2.0
                            kept = best.setdefault(qi, [])
                            kept.extend((-float(line[j]), mine[have[j]]) for j in np.flatnonzero(line >= edge) if mine[have[j]] != keys[qi])
                            kept.sort()
                            del kept[k:]
            flat = [(keys[qi], key_, -c) for qi, kept in best.items() for c, key_ in kept]
            if flat:
                q, v, c = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(q, key_type), pa.array(v, key_type), pa.array(c, pa.float64())], ["query_key", key, "score"])

        found = usable(vectors).mapInArrow(scan, f"query_key {kind}, `{key}` {kind}, score double")
        parts.append(found if blocks == 1 else staged(found))
        if blocks > 1:
            handle.destroy()
    score = F.col("score") if round_to is None else F.round("score", round_to)
    by = Window.partitionBy("query_key").orderBy(F.desc("score"), key)
    return reduce(DataFrame.unionByName, parts).withColumn("score", score).withColumn("rank", F.row_number().over(by) - 1).filter(F.col("rank") < k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def similarity_score(cosine):
    """A cosine on the scale from 0 to 1 that score floors are set for."""
    return (1 + cosine) / 2
