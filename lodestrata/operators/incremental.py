"""Processing only new or changed records.

A run rereads the source from the oldest transaction that was open when the
last successful run began, so nothing that arrived late is skipped, and an
anti-join of key-and-version pairs against the ledger of what was processed
takes out the overlap, so nothing is repeated.

``IncrementalRun`` keeps the ledger on storage and survives failures: a run
publishes its output and ledger under its own name and only then its marker;
a run without marker never happened. ``deltas_of_runs`` replays a whole
history of runs in one plan, by the same reread and the same anti-join with
the ledger that each run found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.paths import normal_hash, normal_path
from lodestrata.session import plan_bytes, staged

BROADCAST_BYTES = 8 << 20


def ledger_rows(file_hashes: DataFrame, version_meta: DataFrame) -> DataFrame:
    """(patchline, corpus_type, file_path, batch_id, indexed_at, file_hash), one row a file and batch.

    Paths and hashes are normalised; rows without path, hash or batch don't
    count; of several rows of one file and batch the greatest indexed_at holds
    (null is the oldest), then the greatest hash. Copies collapse before the
    shuffle, so a file that holds most of the rows is no hot key.
    """
    return _usable(file_hashes, version_meta).groupBy("patchline", "corpus_type", "file_path", "batch_id").agg(F.max(F.struct("indexed_at", "file_hash")).alias("row")).select("patchline", "corpus_type", "file_path", "batch_id", "row.indexed_at", "row.file_hash")


def _usable(file_hashes: DataFrame, version_meta: DataFrame) -> DataFrame:
    """The deliveries' rows that count, with their patchline, path and hash in normal form."""
    slugs = version_meta.select("slug", "patchline").filter(F.col("slug").isNotNull()).distinct()
    slugs = F.broadcast(slugs) if plan_bytes(slugs) <= BROADCAST_BYTES else slugs
    rows = file_hashes.select("slug", "corpus_type", normal_path(F.col("file_path")).alias("file_path"), F.col("batch_id").cast("bigint").alias("batch_id"), "indexed_at", normal_hash(F.col("file_hash")).alias("file_hash"))
    return rows.filter("file_path is not null and file_hash is not null and batch_id is not null").join(slugs, "slug")


def run_windows(index_runs: DataFrame) -> DataFrame:
    """(patchline, corpus_type, run_id, from_batch, through_batch) of each successful run.

    from_batch is through_batch of the successful run before, null for the
    first. A run reported twice counts once; status in any letter case.
    """
    good = index_runs.filter(F.lower(F.trim("run_status")) == "success").filter("run_id is not null and through_batch is not null")
    good = good.select("patchline", "corpus_type", "run_id", F.col("through_batch").cast("bigint").alias("through_batch")).groupBy("patchline", "corpus_type", "run_id").agg(F.max("through_batch").alias("through_batch"))
    before = F.lag("through_batch").over(Window.partitionBy("patchline", "corpus_type").orderBy("run_id"))
    return good.select("patchline", "corpus_type", "run_id", before.alias("from_batch"), "through_batch")


def reread_batches(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(patchline, corpus_type, batch_id, run_id, back): the batches that each run reads again.

    A run begins at the oldest batch that was still open to the run before.
    If it covers less than that one (``back``), the batches between are those
    that it sees differently. Ranges are compared with the different batches
    of a corpus, not with its files.
    """
    first = F.lit(-(2**63))
    low = F.when(F.col("from_batch").isNull(), first).otherwise(F.least("from_batch", "through_batch"))
    spans = windows.select("patchline", "corpus_type", "run_id", low.alias("low"), F.greatest("from_batch", "through_batch").alias("high"), F.coalesce(F.col("from_batch") > F.col("through_batch"), F.lit(False)).alias("back"))
    batches = rows.select("patchline", "corpus_type", "batch_id").distinct()
    return batches.join(spans, ["patchline", "corpus_type"]).filter("batch_id > low and batch_id <= high").select("patchline", "corpus_type", "batch_id", "run_id", "back")


def deltas_of_runs(file_hashes: DataFrame, index_runs: DataFrame, version_meta: DataFrame) -> DataFrame:
    """(run_id, file_path, file_hash, change): what each successful run had to process.

    Each run rereads its batches; the pairs of file and version that are then
    current are what it may have to process. Every pair goes to the ledger
    under the next run that rereads the file, which is the run that finds it
    there as the file's last processed version. An anti-join with the ledger
    takes out the overlap. ``change`` is ``new`` if the ledger has no version
    of the file, else ``changed``. If a run covers less than the one before,
    what it sees differently comes out just so. Empty tables give no rows.
    """
    keys = ["patchline", "corpus_type", "file_path"]
    rows = ledger_rows(file_hashes, version_meta)
    by_batch = Window.partitionBy(*keys).orderBy("batch_id")
    state = F.struct("indexed_at", "batch_id", "file_hash")
    upto = F.max(state).over(by_batch.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = F.max(state).over(by_batch.rowsBetween(Window.unboundedPreceding, -1))
    states = rows.select(*keys, "batch_id", upto.getField("file_hash").alias("after"), earlier.getField("file_hash").alias("before"))

    reread = staged(reread_batches(_usable(file_hashes, version_meta), run_windows(index_runs)))
    reread = F.broadcast(reread) if plan_bytes(reread) <= BROADCAST_BYTES else reread
    touched = states.join(reread, ["patchline", "corpus_type", "batch_id"])
    current = F.when(F.first("back"), F.min_by("before", "batch_id")).otherwise(F.max_by("after", "batch_id"))
    pairs = touched.groupBy(*keys, "run_id").agg(current.alias("file_hash"))

    by_run = Window.partitionBy(*keys).orderBy("run_id")
    processed = pairs.withColumns({"found_by": F.lead("run_id").over(by_run), "known": F.lag("file_hash").over(by_run).isNotNull()})
    ledger = processed.filter("found_by is not null and file_hash is not null").select(*keys, F.col("found_by").alias("run_id"), "file_hash")
    fresh = processed.filter("file_hash is not null").join(ledger, [*keys, "run_id", "file_hash"], "left_anti")
    return fresh.select("run_id", "file_path", "file_hash", F.when(F.col("known"), "changed").otherwise("new").alias("change"))


def found_deltas(file_hashes: DataFrame, index_runs: DataFrame, version_meta: DataFrame) -> DataFrame:
    """Distinct (run_id, file_path). A run belongs to one patchline and corpus, so rows are distinct as they come."""
    return deltas_of_runs(file_hashes, index_runs, version_meta).select("run_id", "file_path")


class IncrementalRun:
    """A source read in runs, exactly once, with its ledger on shared storage.

    ``root`` holds ``ledger/run=<n>`` (key, version, position), ``output/run=<n>``
    and, written last, ``done/run=<n>`` with the run's position: the greatest
    transaction that had ended when the run began. A failed run leaves no
    marker; its folders are overwritten by the next attempt at that number.

    A row comes out if the ledger hasn't its key, version and position, if it
    isn't older than what the ledger has of its key, and if it is another
    version than the last one (so a return to an earlier version counts, an
    older state that arrives late doesn't). Null keys, versions and positions
    are values of their own, a null position being the oldest. Of several rows
    of one key that are due, the greatest position holds, then the greatest
    version.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], version: str, position: str) -> None:
        self.spark, self.root, self.keys, self.version, self.position = spark, root.rstrip("/"), keys, version, position

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def done(self) -> list[tuple[int, int]]:
        """(number, oldest transaction open) of the successful runs, in order."""
        if not self._exists(f"{self.root}/done"):
            return []
        rows = self.spark.read.schema("run bigint, open_from bigint").parquet(f"{self.root}/done/*").collect()
        return sorted((r["run"], r["open_from"]) for r in rows)

    def pending(self, source: DataFrame) -> DataFrame:
        """The rows to process now: reread from the oldest open transaction, without what is in the ledger."""
        return self._decided(source).filter("__due").select(*source.columns)

    def _decided(self, source: DataFrame) -> DataFrame:
        """The reread rows of each key's newest position that the ledger hasn't, with ``__current`` for the one that holds and ``__due`` if it is to be processed."""
        runs = self.done()
        columns = [*self.keys, self.version, self.position]
        fresh = source if not runs else source.filter(F.col(self.position).isNull() | (F.col(self.position) >= runs[-1][1]))
        fresh = fresh.withColumn("__copy", F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(0)))).filter("__copy = 1").drop("__copy")
        last = F.lit(None).cast(T.StructType([T.StructField("p", source.schema[self.position].dataType), T.StructField("v", source.schema[self.version].dataType)]))
        if runs:
            ledger = self.history()
            fresh = fresh.join(ledger.alias("l"), self._same("l", columns), "left_anti")
            fresh = fresh.join(self.current_ledger().withColumn("__last", F.struct(F.col(f"__l_{self.position}").alias("p"), F.col(f"__l_{self.version}").alias("v"))).alias("c"), self._same("c", self.keys), "left").select(*source.columns, "__last")
        else:
            fresh = fresh.withColumn("__last", last)
        at, was = F.struct(F.col(self.position).alias("p")), F.struct(F.col("__last.p").alias("p"))
        fresh = fresh.filter(F.col("__last").isNull() | (at >= was))
        by = Window.partitionBy(*self.keys).orderBy(F.col(self.position).desc_nulls_last(), F.col(self.version).desc_nulls_last())
        newest = F.first(self.position).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ranked = fresh.withColumns({"__current": F.row_number().over(by) == 1, "__newest": newest}).filter(F.col(self.position).eqNullSafe(F.col("__newest")))
        due = F.col("__last").isNull() | ~F.col(self.version).eqNullSafe(F.col("__last.v"))
        return ranked.withColumn("__due", F.col("__current") & due).drop("__last", "__newest")

    def _same(self, side: str, columns: list[str]) -> Column:
        return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{side}.__l_{c}")) for c in columns))

    def history(self) -> DataFrame:
        """What the ledger has: the newest whole state (see ``compact``) and the parts of the runs after it."""
        runs = [n for n, _ in self.done()]
        whole = [n for n in self._compacted() if n in runs]
        base = whole[-1] if whole else 0
        paths = ([f"{self.root}/whole/upto={base}"] if base else []) + [f"{self.root}/ledger/run={n}" for n in runs if n > base]
        return self.spark.read.parquet(*paths)

    def current_ledger(self) -> DataFrame:
        """Each key's last processed version and its position."""
        place = [f"__l_{self.position}", "__run", "__current", f"__l_{self.version}"]
        last = self.history().groupBy(*(f"__l_{k}" for k in self.keys)).agg(F.max(F.struct(*place)).alias("r"))
        return last.select(*(f"__l_{k}" for k in self.keys), *(F.col("r").getField(c).alias(c) for c in place))

    def _compacted(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/whole")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        folders = [s.getPath() for s in fs.listStatus(at)]
        ready = [p for p in folders if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in ready)

    def compact(self) -> None:
        """The ledger's parts as one whole state, so that a run reads a key's newest position, not a part a run. A state without its mark of success isn't used."""
        runs = self.done()
        if runs and runs[-1][0] not in self._compacted():
            rows, last = self.history().alias("h"), self.current_ledger().alias("l")
            same = reduce(lambda a, b: a & b, (F.col(f"h.__l_{c}").eqNullSafe(F.col(f"l.__l_{c}")) for c in [*self.keys, self.position]))
            rows.join(last, same, "left_semi").write.mode("overwrite").parquet(f"{self.root}/whole/upto={runs[-1][0]}")

    def run(self, source: DataFrame, open_from: int) -> DataFrame:
        """Process what is pending; ``open_from`` is the oldest transaction still open now. Returns the run's output."""
        n = (self.done() or [(0, 0)])[-1][0] + 1
        out = f"{self.root}/output/run={n}"
        decided = staged(self._decided(source))
        decided.filter("__due").select(*source.columns).write.mode("overwrite").parquet(out)
        decided.select(*(F.col(c).alias(f"__l_{c}") for c in [*self.keys, self.version, self.position]), "__current", F.lit(n).alias("__run")).write.mode("overwrite").parquet(f"{self.root}/ledger/run={n}")
        self.spark.createDataFrame([(n, open_from)], "run bigint, open_from bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/done/run={n}")
        return self.spark.read.schema(source.schema).parquet(out)
