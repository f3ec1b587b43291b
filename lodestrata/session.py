"""Session factory, table access and the few settings every plan relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "12g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with the library's defaults; what was submitted, the master and any setting, goes before them."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra | {"spark.master": master}
    given = _submitted()
    builder = SparkSession.builder.appName("lodestrata")
    for key, value in conf.items():
        if key not in given:
            builder = builder.config(key, value)
    return builder.getOrCreate()


def _submitted() -> dict[str, str]:
    """The settings with which spark-submit started this process; none if it was started otherwise."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return {}
    SparkContext._ensure_initialized()
    return dict(SparkConf().getAll())


def ship(spark: SparkSession) -> None:
    """The package to the executors' Python, once a session, as they may not have it installed.

    In local mode, where the workers see the driver's path anyway, there is nothing to do.
    """
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    context._lodestrata_shipped = True
    package = Path(__file__).resolve().parent
    seen = {os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    if context.master.startswith("local") and not context.master.startswith("local-") and str(package.parent) in seen:
        return
    folder = tempfile.mkdtemp(prefix="lodestrata-")  # the driver's own; its file server hands the archive out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "lodestrata.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(archive)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data folder (a file or a folder of Parquet parts)."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is this machine alone (tests, a laptop) a local folder is
    made; a cluster without the setting is refused, as its executors would
    write where the others can't read. The folder, which is the application's
    own, goes when the session's Python ends.
    """
    ship(spark)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not _one_machine(context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or f"file://{os.path.join(tempfile.gettempdir(), 'lodestrata-checkpoints')}")
    made = context._jsc.sc().getCheckpointDir().get()
    atexit.register(remove, spark, made)
    return made


def _one_machine(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies; a session that is gone leaves it."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone
        return


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Unlike localCheckpoint this survives the loss of any executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, for wide intermediate results that are read more than once.

    Reads of it prune columns. The table goes with the folder.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``, in bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Bytes of input that a task of a costly walk should have, about.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame, clustered: bool = False) -> DataFrame:
    """``df`` with its rows dealt out evenly, where the splits of its files would load the cores unevenly.

    For steps that cost much more than moving their rows. Few bytes in fewer
    files than there are cores are dealt out over the cores. ``clustered`` says
    that the rows that count lie together in few row groups, as those that a
    filter keeps do, and would all be a few tasks' work: they are dealt out
    whatever their size. What has been shuffled before is left as it is.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(plan.stats().sizeInBytes())
    if not _scan_only(plan) or not (clustered or (size < cores * SPREAD_BYTES and len(df.inputFiles()) < cores)):
        return df
    return df.repartition(max(2 * cores, size // SPREAD_BYTES))


def _scan_only(plan) -> bool:
    """Whether a plan is one scan with projections and filters."""
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith("LogicalRelation")
