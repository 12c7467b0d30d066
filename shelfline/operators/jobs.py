"""Archive and restore jobs: plans, steps, statuses, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions import values
from shelfline.schema import COPY_STATUS, JOB_STATUS, JOB_STEP, is_regular

PENDING, RUNNING, STAGED, SUBMITED, FAILED = (COPY_STATUS[k] for k in ("PENDING", "RUNNING", "STAGED", "SUBMITED", "FAILED"))

# The steps that may follow each other, and a job's status in each.
TRANSITIONS = [("PENDING", "WAIT_FOR_TAPE"), ("COPYING", "WAIT_FOR_TAPE"), ("WAIT_FOR_TAPE", "COPYING"), ("COPYING", "FINISHED")]
STATUS_OF_STEP = {"PENDING": "PENDING", "WAIT_FOR_TAPE": "PROCESSING", "COPYING": "PROCESSING", "FINISHED": "COMPLETED"}


def check_transitions(log: DataFrame) -> DataFrame:
    """Rows ``(job_id, seq, step)`` with from_step, whether the step may follow it, and the status that it gives.

    A job starts at PENDING. The legal pairs are a table of four rows."""
    pairs = log.sparkSession.createDataFrame([(JOB_STEP[a], JOB_STEP[b]) for a, b in TRANSITIONS], "from_step int, step int").withColumn("legal", F.lit(True))
    before = F.lag("step", 1, JOB_STEP["PENDING"]).over(Window.partitionBy("job_id").orderBy("seq"))
    status = F.create_map(*[F.lit(x) for step, name in STATUS_OF_STEP.items() for x in (JOB_STEP[step], JOB_STATUS[name])])
    rows = log.withColumn("from_step", before).join(F.broadcast(pairs), ["from_step", "step"], "left")
    return rows.select("job_id", "seq", "from_step", "step", F.coalesce("legal", F.lit(False)).alias("legal"), F.try_element_at(status, F.col("step")).alias("status"))


def archive_plan(sources: DataFrame, base: str) -> DataFrame:
    """Sources ``(path array<string>, size)`` in order of their segments, all pending; a path twice is an error."""
    again = sources.groupBy("path").count().where("count > 1")
    if not again.isEmpty():
        raise ValueError(f"the same source twice: {again.first()['path']}")
    return sources.select(F.lit(base).alias("base"), "path", "size", F.lit(PENDING).alias("status"), F.lit(None).cast("string").alias("message")).orderBy("path", "base")


def normal_base(base: str, source_dir: str) -> str:
    """A relative base lies under the configured folder."""
    return base.rstrip("/") + "/" if base.startswith("/") else f"{source_dir.rstrip('/')}/{base.strip('/')}/".replace("//", "/")


def duplicate_sources(sources: DataFrame) -> DataFrame:
    return sources.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


def _latest(events: DataFrame, *key: str) -> DataFrame:
    """The last event of each key; the maximum of a struct is taken before the shuffle."""
    rest = [c for c in events.columns if c not in (*key, "seq")]
    return events.groupBy(*key).agg(F.max(F.struct("seq", *rest)).alias("e")).select(*key, "e.*")


def archive_status(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Sources ``(path, status)`` after copy events ``(seq, path, event, successes)``; events of unknown paths don't count."""
    new = F.when(F.col("event").isin("pending", "preparing"), PENDING).when(F.col("event") == "copying", RUNNING).when(F.col("event") == "finished", F.when(F.col("successes") > 0, STAGED).otherwise(FAILED))
    last = _latest(events.where(F.col("event").isin("pending", "preparing", "copying", "finished")), "path").select("path", new.alias("_new"))
    return sources.join(last, "path", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def record_sources(sources: DataFrame, recorded: DataFrame) -> DataFrame:
    """Sources that the catalog holds now are submitted."""
    done = recorded.select("path").distinct().withColumn("_done", F.lit(True))
    return sources.join(done, "path", "left").withColumn("status", F.when(F.col("_done"), SUBMITED).otherwise(F.col("status"))).drop("_done")


def release_unsubmitted(sources: DataFrame) -> DataFrame:
    """After a failed load, or when a tape turned read-only: all that isn't submitted is pending again."""
    return sources.withColumn("status", F.when(F.col("status") == SUBMITED, SUBMITED).otherwise(PENDING))


def verified(sha: Column, size: Column, want_hash: Column, want_size: Column) -> Column:
    """Whether a copy has the hash and the size that the catalog has."""
    return F.lower(sha).eqNullSafe(values.hex_lower(want_hash)) & size.eqNullSafe(want_size)


def restore_status(files: DataFrame, events: DataFrame) -> DataFrame:
    """Plan rows ``(barcode, tape_path, hash, size, status)`` after events ``(seq, barcode, tape_path, event, failures, sha256, got_size)``."""
    last = _latest(events.where(F.col("event").isin("pending", "preparing", "finished")), "barcode", "tape_path")
    rows = files.join(last, ["barcode", "tape_path"], "left")
    good = (F.coalesce("failures", F.lit(0)) == 0) & verified(F.col("sha256"), F.col("got_size"), F.col("hash"), F.col("size"))
    new = F.when(F.col("event") == "pending", PENDING).when(F.col("event") == "preparing", RUNNING).when(F.col("event") == "finished", F.when(good, STAGED).otherwise(FAILED))
    return rows.withColumn("status", F.coalesce(new, "status")).select(*files.columns)


def submit_staged(files: DataFrame) -> DataFrame:
    return files.withColumn("status", F.when(F.col("status") == STAGED, SUBMITED).otherwise(F.col("status")))


def tape_status(tapes: DataFrame, files: DataFrame) -> DataFrame:
    """``(tape_id, status)``: submitted if all its files are, or it has none; else failed."""
    every = files.groupBy("tape_id").agg(F.every(F.col("status") == SUBMITED).alias("all"))
    return tapes.select("tape_id").join(every, "tape_id", "left").select("tape_id", F.when(F.coalesce("all", F.lit(True)), SUBMITED).otherwise(FAILED).alias("status"))


def job_finished(tapes: DataFrame) -> DataFrame:
    return tapes.agg((~F.coalesce(F.bool_or(F.col("status") != SUBMITED), F.lit(False))).alias("finished"))


def work_left(jobs: DataFrame) -> DataFrame:
    """``(id, left)``: of an archive job the sources, of a restore job the tapes that aren't submitted."""
    open_ = lambda xs: F.greatest(F.coalesce(F.size(F.filter(xs, lambda x: ~x["status"].eqNullSafe(F.lit(SUBMITED)))), F.lit(0)), F.lit(0))
    return jobs.select("id", (open_("state.archive.sources") + open_("state.restore.tapes")).alias("left"))


def remaining(sources: DataFrame) -> DataFrame:
    return sources.agg(F.coalesce(F.sum(F.when(F.col("status") != SUBMITED, 1).otherwise(0)), F.lit(0)).alias("remaining"))


def report_files(report: DataFrame) -> DataFrame:
    """Rows for the catalog from a copy report: copied at least once, regular, with a hash that is hex."""
    hashed = report.where((F.col("successes") > 0) & is_regular(F.col("mode"))).withColumn("hash", values.unhex_or_null(F.col("sha256")))
    return hashed.where(F.col("hash").isNotNull()).select("path", "size", "mode", "mod_time", "write_time", "hash")


def report_sources(report: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that a report's successes are about: an equi-join by path, whatever the order."""
    return sources.join(report.where("successes > 0").select("path").distinct(), "path", "left_semi")


def by_barcode(plan: DataFrame, tape_barcode: str) -> DataFrame:
    return plan.where(F.col("barcode") == values.barcode(F.lit(tape_barcode)))


def archive_card(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """Progress of archive jobs ``(id, sources array<struct<size,status>>)`` with live counts ``(id, copied_bytes, copied_files, speed)``."""
    done = lambda s: s["status"] == SUBMITED
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, s: a + s["size"])
    card = jobs.select("id", F.size("sources").alias("total_files"), total(F.col("sources")).alias("total_bytes"), F.size(F.filter("sources", done)).alias("submited_files"), total(F.filter("sources", done)).alias("submited_bytes"))
    return _with_live(card, live)


def restore_card(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """The same of restore jobs ``(id, tapes array<struct<files array<struct<size,status>>>>)``, and what is copied or staged."""
    files = jobs.select("id", F.flatten(F.transform("tapes", lambda t: t["files"])).alias("files"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, s: a + s["size"])
    done, good = (lambda s: s["status"] == SUBMITED), (lambda s: s["status"].isin(SUBMITED, STAGED))
    card = files.select("id", F.size("files").alias("total_files"), total(F.col("files")).alias("total_bytes"), F.size(F.filter("files", done)).alias("submited_files"), total(F.filter("files", done)).alias("submited_bytes"), F.size(F.filter("files", good)).alias("success_files"), total(F.filter("files", good)).alias("success_bytes"))
    return _with_live(card, live)


def _with_live(card: DataFrame, live: DataFrame) -> DataFrame:
    card = card.join(live.select("id", "copied_bytes", "copied_files", "speed"), "id", "left")
    copied = F.col("submited_bytes") + F.coalesce("copied_bytes", F.lit(0))
    card = card.withColumns({"copied_files": F.col("submited_files") + F.coalesce("copied_files", F.lit(0)), "copied_bytes": copied})
    return card.withColumns({"progress": values.progress(F.col("copied_bytes"), F.col("total_bytes")), "eta_s": values.eta_seconds(F.col("total_bytes") - F.col("copied_bytes"), F.col("speed"))})


def job_list_with_live(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """Live counts for jobs that are being processed; the others have none."""
    now = live.withColumn("_status", F.lit(JOB_STATUS["PROCESSING"]))
    return jobs.join(now, (jobs["id"] == now["id"]) & (jobs["status"] == now["_status"]), "left").select(jobs["*"], *[now[c] for c in live.columns if c != "id"])


def rollback(states: DataFrame, at: Column) -> DataFrame:
    """Sources from the given place (from 0) on are pending again, inside each job's array."""
    return states.withColumn("sources", F.transform("sources", lambda s, i: F.when(i >= at, s.withField("status", F.lit(PENDING))).otherwise(s)))


def first_unfinished(states: DataFrame) -> DataFrame:
    """Place of the first source that isn't submitted; null where all are."""
    at = F.filter(F.transform("sources", lambda s, i: F.when(s["status"] != SUBMITED, i)), lambda i: i.isNotNull())
    return states.select("id", F.try_element_at(at, F.lit(1)).alias("first_unfinished"))


def new_job(jobs: DataFrame, state: Column, priority: int, now_ns: Column) -> DataFrame:
    """One more job, pending, with the next id and the plan that it was given."""
    first = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    row = jobs.sparkSession.range(1).select(F.lit(first + 1).cast("long").alias("id"), F.lit(JOB_STATUS["PENDING"]).alias("status"), F.lit(priority).cast("long").alias("priority"), now_ns.alias("create_time_ns"), now_ns.alias("update_time_ns"), state.cast(jobs.schema["state"].dataType).alias("state"))
    return jobs.unionByName(row.select(*jobs.columns))


def exactly_one_kind(jobs: DataFrame) -> DataFrame:
    """Jobs whose state is not of exactly one kind."""
    kinds = [F.col(f"state.{c}").isNotNull().cast("int") for c in ("archive", "restore")]
    return jobs.where(F.col("state").isNull() | (kinds[0] + kinds[1] != 1))


