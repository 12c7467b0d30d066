"""The change feed of jobs and the tail of logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from shelfline.operators.scans import merge_feed
from shelfline.sources.snapshots import Catalog


def follow_changes(changes: DataFrame, catalog: Catalog, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merges each micro-batch of changed rows into a snapshot table; the latest update of an id stays.

    A batch that is run again after a failure merges the same rows, so the result is the same."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            catalog.commit({table: merge_feed(catalog.read(table, batch.schema), batch)})

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(job_id, line)`` of new files under ``job_id=...`` folders as a stream."""
    return spark.readStream.schema("value string, job_id long").option("basePath", folder).text(f"{folder}/*").select("job_id", F.col("value").alias("line"))


def stop_all(spark: SparkSession, timeout_s: int = 30) -> None:
    """Ends all running streams, each after its micro-batch."""
    for q in spark.streams.active:
        q.stop()
        q.awaitTermination(timeout_s)
