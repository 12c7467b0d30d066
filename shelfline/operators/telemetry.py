"""Copy telemetry: sliding rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions import values

WINDOW_EVENTS = 30


def copy_speed(events: DataFrame, window: int = WINDOW_EVENTS) -> DataFrame:
    """Events ``(job_id, t, bytes, *order)`` with the speed over the last ``window`` of a job, in whole bytes a second.

    0 for a job's first event, null where no time has passed. The difference is taken in decimals, so long windows
    don't overflow."""
    frame = Window.partitionBy("job_id").orderBy("t", "bytes").rowsBetween(-(window - 1), 0)
    t = values.to_nanos(F.col("t"))
    rows = events.withColumns({"_b": F.first("bytes").over(frame), "_t": F.first(t).over(frame), "_n": F.count("*").over(frame)})
    passed = (t - F.col("_t")).cast("decimal(20,0)")
    copied = (F.col("bytes") - F.col("_b")).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    speed = F.when(F.col("_n") == 1, F.lit(0)).when(passed != 0, F.floor(copied / passed))
    return rows.withColumn("speed", speed.cast("long")).drop("_b", "_t", "_n")


def live_counts(progress: DataFrame) -> DataFrame:
    """``(id, copied_bytes, copied_files, speed)`` of each job after its progress events ``(job_id, t, bytes, files)``: the latest event's."""
    events = copy_speed(progress)
    last = events.groupBy("job_id").agg(F.max_by(F.struct("bytes", "files", "speed"), F.struct("t", "bytes")).alias("e"))
    return last.select(F.col("job_id").alias("id"), F.col("e.bytes").alias("copied_bytes"), F.col("e.files").alias("copied_files"), F.col("e.speed").alias("speed"))
