"""Continuous ingest: a stream of delivered rows, applied batch by batch exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.incremental import IncrementalRun


def deliveries(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def apply_deliveries(stream: DataFrame, run: IncrementalRun, checkpoint: str, then: Callable[[DataFrame], None] | None = None, once: bool = True) -> StreamingQuery:
    """Each micro-batch through the ledger, so that a replayed batch or row brings nothing twice.

    ``then`` gets the rows that were new or changed. Every transaction counts
    as open, since a stream can bring any of them again; the ledger takes the
    overlap out.
    """

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            made = run.run(batch, 0)
            if then is not None:
                then(made)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def event_counts(events: DataFrame, window: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total): events by tumbling window; rows later than the watermark are left out when streaming.

    Works on a stream or a table with ts, event_type and value.
    """
    late = events.withWatermark("ts", lateness) if events.isStreaming else events
    return late.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
