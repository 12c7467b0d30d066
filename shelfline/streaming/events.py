"""Copy events as a stream: the status of each file, and the sliding rate of each job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from shelfline.operators.telemetry import WINDOW_EVENTS

STATUS_EVENTS = "job_id long, seq long, path string, event string, successes long"
PROGRESS_EVENTS = "job_id long, t timestamp, bytes long"


def read_events(spark: SparkSession, folder: str, schema: str | StructType, max_files: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(folder)


def latest_status(events: DataFrame) -> DataFrame:
    """The last known event of each job's path, whatever order events arrive in; for update or complete mode.

    A streaming aggregate: the state is one row a path, kept and merged inside the JVM."""
    known = events.where(F.col("event").isin("pending", "preparing", "copying", "finished"))
    return known.groupBy("job_id", "path").agg(F.max(F.struct("seq", "event", "successes")).alias("e")).select("job_id", "path", "e.*")


def _speed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, window: int) -> Iterator[pd.DataFrame]:
    times, amounts = (list(x) for x in state.get) if state.exists else ([], [])
    rows = pd.concat(list(batches)).sort_values(["t", "bytes"], kind="stable")
    speeds: list[int | None] = []
    for t, amount in zip(rows["t"].astype("datetime64[ns]").astype("int64").tolist(), rows["bytes"].tolist(), strict=True):
        times, amounts = [*times, t][-window:], [*amounts, int(amount)][-window:]
        passed = times[-1] - times[0]
        copied = (amounts[-1] - amounts[0]) * 1_000_000_000
        speeds.append(0 if len(times) == 1 else None if not passed else copied // passed)
    state.update((times, amounts))
    yield pd.DataFrame({"job_id": key[0], "t": rows["t"], "bytes": rows["bytes"], "speed": pd.array(speeds, dtype="Int64")})


def copy_speed_stream(events: DataFrame, window: int = WINDOW_EVENTS) -> DataFrame:
    """Each event with the speed over its job's last ``window`` events, in order of time within a micro-batch.

    Spark has no windows by row count on streams, so the last events of each job are its state."""
    return events.groupBy("job_id").applyInPandasWithState(lambda k, b, s: _speed(k, b, s, window), "job_id long, t timestamp, bytes long, speed long", "times array<long>, amounts array<long>", "append", GroupStateTimeout.NoTimeout)
