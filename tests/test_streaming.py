"""Streams driven to their end by files."""

from __future__ import annotations

import datetime as dt

from shelfline.operators import telemetry
from shelfline.sources.snapshots import Catalog
from shelfline.streaming import events, feeds


def test_latest_status_and_speed(spark, tmp_path):
    src = str(tmp_path / "status")
    rows = [(1, 1, "a", "pending", 0), (1, 3, "a", "finished", 1), (1, 2, "a", "copying", 0), (1, 4, "b", "noise", 0), (1, 5, "c", "pending", 0)]
    for r in rows:
        spark.createDataFrame([r], events.STATUS_EVENTS).coalesce(1).write.mode("append").parquet(src)
    stream = events.latest_status(events.read_events(spark, src, events.STATUS_EVENTS, max_files=2))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest_status").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["path"], r["event"]) for r in spark.sql("select * from latest_status").collect()) == [("a", "finished"), ("c", "pending")]


def test_speed_stream_equals_batch(spark, tmp_path):
    start, src = dt.datetime(2024, 1, 1), str(tmp_path / "progress")
    rows = [(job, start + dt.timedelta(seconds=i * 2), 7 * i * i + job) for job in (1, 2) for i in range(45)]
    for k in range(3):
        spark.createDataFrame([r for n, r in enumerate(rows) if n % 45 // 15 == k], events.PROGRESS_EVENTS).coalesce(1).write.mode("append").parquet(src)
    stream = events.copy_speed_stream(events.read_events(spark, src, events.PROGRESS_EVENTS, max_files=1))
    q = stream.writeStream.outputMode("append").format("memory").queryName("speeds").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    batch = telemetry.copy_speed(spark.createDataFrame(rows, events.PROGRESS_EVENTS))
    key = lambda df: sorted(tuple(r) for r in df.select("job_id", "t", "bytes", "speed").collect())
    assert key(spark.sql("select * from speeds")) == key(batch)


def test_follow_changes(spark, tmp_path):
    schema = "id long, status int, update_time_ns long"
    src = str(tmp_path / "changes")
    for rows in ([(1, 2, 10), (2, 2, 11)], [(1, 3, 12)], [(1, 2, 11), (3, 4, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    store = Catalog(spark, f"file://{tmp_path}/catalog")
    changes = events.read_events(spark, src, "id long, status int, update_time_ns long", max_files=1)
    feeds.follow_changes(changes, store, "job", str(tmp_path / "c3")).awaitTermination(180)
    assert sorted(tuple(r) for r in store.read("job").collect()) == [(1, 3, 12), (2, 2, 11), (3, 4, 1)]
    feeds.stop_all(spark)
    assert not spark.streams.active
