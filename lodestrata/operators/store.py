"""Writing an index: partitions by version and corpus, deltas, sidecars."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import catalog
from lodestrata.operators.incremental import IncrementalRun
from lodestrata.session import remove, staged

LAYOUT = ("slug", "corpus")


def write_nodes(nodes: DataFrame, root: str) -> None:
    """Nodes by version and corpus, each partition replaced as a whole and sorted by id for the readers' row groups."""
    nodes.repartition(*LAYOUT, F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions("id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(f"{root}/nodes")


def apply_delta(spark: SparkSession, root: str, delta: DataFrame, deleted: DataFrame, keys: tuple[str, ...] = ("slug", "corpus", "id")) -> None:
    """``delta`` put in place of the stored rows of its keys, rows of ``deleted`` owners taken out; only touched partitions are rewritten.

    The new state is written beside the old before it takes its place. A
    partition that has come out empty goes.
    """
    stored = spark.read.parquet(f"{root}/nodes")
    touched = staged(delta.select(*LAYOUT).unionByName(deleted.select(*LAYOUT)).distinct())
    mine = stored.alias("s").join(touched.alias("t"), reduce(lambda a, b: a & b, (F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in LAYOUT)), "left_semi")
    kept = catalog.delete_by_key(mine, deleted, [*LAYOUT, "owning_file"])
    made = staged(catalog.upsert(kept.select(*delta.columns), delta, list(keys)))
    write_nodes(made, root)
    drop_partitions(spark, f"{root}/nodes", touched.subtract(made.select(*LAYOUT).distinct()))


def drop_partitions(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Delete the folders of partitions, which the columns of ``gone`` name in the order of the layout.

    A row a partition, so as many as there are folders, come to the driver.
    """
    jvm = spark._jvm
    for row in gone.collect():
        parts = [jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(c, row[c]) for c in gone.columns]
        remove(spark, "/".join([path, *parts]))


def index_corpora(indexers: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame | Exception]:
    """Each corpus's result or its error; a corpus that fails doesn't stop the others."""
    out: dict[str, DataFrame | Exception] = {}
    for corpus, build in indexers.items():
        try:
            out[corpus] = build()
        except Exception as e:  # noqa: BLE001
            out[corpus] = e
    return out


def incremental(spark: SparkSession, root: str) -> IncrementalRun:
    """Files of a source, processed once for each content they have had."""
    return IncrementalRun(spark, root, ["file_path"], "file_hash", "batch_id")


def needs_rebuild(stored_version: int | None, builder_version: int, has_nodes: bool) -> bool:
    """Whether nodes were built by another version of the text builder."""
    return has_nodes and stored_version != builder_version


def version_slug(patchline: str, build: int, date: str, short_hash: str) -> str:
    return f"{patchline}_b{build}_{date}-{short_hash}"


def version_sidecar(meta: dict) -> str:
    return json.dumps(meta, indent=2, ensure_ascii=False, default=str)


def write_snapshot(states: DataFrame, path: str) -> None:
    """A version's node summaries as JSON lines, without contents; an existing snapshot stays."""
    states.drop("content").write.mode("ignore").json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot; it has no contents, so differences have no details."""
    schema = "id string, corpus string, data_type string, node_type string, display_name string, file_path string, published_date string, content_hash bigint"
    return spark.read.schema(schema).json(path).withColumn("content", F.lit(None).cast("string"))
