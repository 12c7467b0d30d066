"""The library as one object: requests on the current snapshots, each change committed as new ones."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline import schema
from shelfline.operators import jobs as job_ops
from shelfline.operators import listing, mutations, scans, telemetry
from shelfline.plans import restore, tree, trim
from shelfline.plans.stages import cut
from shelfline.sources import catalog_json, filesystem, logs
from shelfline.sources.snapshots import Catalog

JOB_COLUMNS = "id long, status int, priority long, create_time_ns long, update_time_ns long"


class Library:
    """Requests of a catalog. Reads return DataFrames; changes return nothing and are visible once committed."""

    def __init__(self, catalog: Catalog, source_dir: str = ".", log_dir: str = "job-logs") -> None:
        self.catalog, self.spark = catalog, catalog.spark
        self.source_dir, self.log_dir = source_dir.rstrip("/"), log_dir.rstrip("/")

    @property
    def files(self) -> DataFrame:
        return self.catalog.read("file", schema.FILE)

    @property
    def positions(self) -> DataFrame:
        return self.catalog.read("position", schema.POSITION)

    @property
    def tapes(self) -> DataFrame:
        return self.catalog.read("tape", schema.TAPE)

    @property
    def jobs(self) -> DataFrame:
        if "job" in self.catalog.versions():
            return self.catalog.read("job")
        return self.spark.sql(f"select * from (select {', '.join(f'cast(null as {k}) as {c}' for c, k in (f.split() for f in JOB_COLUMNS.split(', ')))}, cast(null as {self._state()}) as state) where false")

    @staticmethod
    def _state() -> str:
        return schema.JOB.split("state ")[1]

    @staticmethod
    def now_ns() -> Column:
        return F.unix_micros(F.current_timestamp()) * 1000

    # Files

    def file_get(self, file_id: int, need_size: bool = False) -> dict[str, DataFrame]:
        """The file, its positions with their tapes, and its children in order of name; the root has no file row and no positions."""
        files = self.files
        if file_id != schema.ROOT_ID:
            scans.get(files, file_id)
        own = files.where(F.col("id") == file_id)
        kids = tree.usage_below(files, file_id) if need_size else scans.children(files, file_id)
        held = self.positions.where((F.col("file_id") == file_id) & (F.col("file_id") != schema.UNLINKED)).join(self.tapes.select(F.col("id").alias("tape_id"), "barcode"), "tape_id")
        return {"file": own, "positions": held, "children": kids}

    def file_edit(self, file_id: int, parent_id: int | None = None, name: str | None = None) -> None:
        self.catalog.commit({"file": mutations.edit(self.files, file_id, parent_id, name)})

    def file_mkdir(self, parent_id: int, path: str) -> int:
        """The id of the directory at the path below a parent, made if it is missing."""
        files, where = mutations.make_directories(self.files, self.spark.createDataFrame([(path,)], "path string"), parent_id)
        made = where.first()["parent_id"]
        self.catalog.commit({"file": files})
        return made

    def file_delete(self, ids: Sequence[int]) -> None:
        self.catalog.commit({"file": mutations.delete(self.files, ids, F.current_timestamp())})

    def file_list_parents(self, file_id: int) -> DataFrame:
        """From the root down, the file last; a broken chain is an error."""
        line = tree.ancestors(self.files, self.spark.createDataFrame([(file_id,)], "id long"))
        if file_id != schema.ROOT_ID and (line.isEmpty() or not line.where("broken").isEmpty()):
            raise scans.NotFound(f"parents of {file_id}")
        return line.orderBy(F.desc("steps")).drop("start", "steps", "broken")

    # Tapes

    def tape_list(self, mget: Sequence[int] | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return scans.multi_get(self.tapes, mget) if mget is not None else scans.list_tapes(self.tapes, limit, offset)

    def tape_delete(self, ids: Sequence[int]) -> None:
        """Positions stay until the next trim."""
        self.catalog.commit({"tape": mutations.delete_tapes(self.tapes, ids)})

    def tape_get_positions(self, tape_id: int, directory: str = "") -> DataFrame:
        return listing.tape_directory(self.positions, tape_id, directory)

    # Jobs

    def job_list(self, mget: Sequence[int] | None = None, status: int | None = None, recent_after_ns: int | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """By id, the changes after a time, or a page of all."""
        if mget is not None:
            return scans.multi_get(self.jobs, mget)
        if recent_after_ns is not None:
            return scans.recent_jobs(self.jobs, recent_after_ns, limit=limit)
        return scans.list_jobs(self.jobs, status, limit, offset)

    def job_create_archive(self, base: str, priority: int = 0) -> int:
        """A job that archives all that lies below a base folder."""
        base = job_ops.normal_base(base, self.source_dir)
        plan = job_ops.archive_plan(filesystem.sources(self.spark, base).select("path", "size"), base)
        source = F.struct(F.struct("base", "path").alias("source"), "size", "status", "message")
        state = plan.agg(F.transform(F.sort_array(F.collect_list(F.struct("path", source.alias("s")))), lambda x: x["s"]).alias("sources"))
        return self._new_job(state.select(F.struct(F.struct(F.lit(0).alias("step"), "sources").alias("archive"), F.lit(None).cast(schema.RESTORE_STATE).alias("restore")).alias("state")), priority)

    def job_create_restore(self, file_ids: Iterable[int], priority: int = 0) -> int:
        """A job that restores a selection, planned over the tapes in the catalog."""
        chosen = self.spark.createDataFrame([(i,) for i in file_ids], "id long")
        state = restore.plan_state(restore.plan(self.files, self.positions, self.tapes, chosen))
        return self._new_job(state.select(F.struct(F.lit(None).cast(schema.ARCHIVE_STATE).alias("archive"), F.struct("step", "tapes").alias("restore")).alias("state")), priority)

    def _new_job(self, state: DataFrame, priority: int) -> int:
        jobs, now = self.jobs, self.now_ns()
        new = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
        row = state.select(F.lit(new).cast("long").alias("id"), F.lit(schema.JOB_STATUS["PENDING"]).alias("status"), F.lit(priority).cast("long").alias("priority"), now.alias("create_time_ns"), now.alias("update_time_ns"), F.col("state").cast(self._state()).alias("state"))
        self.catalog.commit({"job": jobs.unionByName(row)})
        return new

    def job_dispatch(self, job_id: int, step: int) -> None:
        """Takes a job to its next step, which sets its status; an illegal step is an error, as is finishing with work left.

        Left are sources of an archive job, or tapes of a restore job, that aren't submitted."""
        job = scans.get(self.jobs, job_id).select(F.coalesce("state.archive.step", "state.restore.step").alias("step"), F.col("state.archive").isNotNull().alias("archive")).first()
        names = {v: k for k, v in schema.JOB_STEP.items()}
        if (names[job["step"]], names.get(step)) not in job_ops.TRANSITIONS:
            raise ValueError(f"step {step} can't follow {job['step']}")
        if names[step] == "FINISHED" and (left := job_ops.work_left(scans.get(self.jobs, job_id)).first()["left"]):
            raise ValueError(f"{left} sources or tapes are left")
        kind, hit = "archive" if job["archive"] else "restore", F.col("id") == job_id
        state = F.when(hit, F.col("state").withField(f"{kind}.step", F.lit(step))).otherwise(F.col("state"))
        status = F.when(hit, schema.JOB_STATUS[job_ops.STATUS_OF_STEP[names[step]]]).otherwise(F.col("status"))
        self.catalog.commit({"job": self.jobs.withColumns({"state": state, "status": status, "update_time_ns": F.when(hit, self.now_ns()).otherwise(F.col("update_time_ns"))})})

    def job_edit_state(self, job_id: int, status: int | None = None, state: Column | None = None) -> None:
        self.catalog.commit({"job": mutations.edit_job_state(self.jobs, job_id, status, state, self.now_ns())})

    def job_delete(self, ids: Sequence[int]) -> None:
        self.catalog.commit({"job": mutations.delete_jobs(self.jobs, ids, self.now_ns())})

    def job_display(self, job_id: int, live: DataFrame | None = None, progress: DataFrame | None = None) -> DataFrame:
        """The progress card of a job that is being processed, else no row.

        Totals and what is submitted come from the job's state; live counts ``(id, copied_bytes, copied_files, speed)`` as given,
        or from its progress events ``(job_id, t, bytes, files)``."""
        now = self.jobs.where((F.col("id") == job_id) & (F.col("status") == schema.JOB_STATUS["PROCESSING"]))
        if live is None:
            live = telemetry.live_counts(progress) if progress is not None else self.spark.createDataFrame([], "id long, copied_bytes long, copied_files long, speed long")
        archive = job_ops.archive_card(now.where("state.archive is not null").select("id", F.col("state.archive.sources").alias("sources")), live)
        restored = job_ops.restore_card(now.where("state.archive is null").select("id", F.col("state.restore.tapes").alias("tapes")), live)
        return archive.unionByName(restored, allowMissingColumns=True)

    def job_get_log(self, job_id: int, offset: int = 0) -> DataFrame:
        """From the job's log file, or from the folder that ``append_log`` keeps for it."""
        single = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.log_dir}/{job_id}.log")
        fs = single.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return logs.log_tail(self.spark, f"{self.log_dir}/{job_id}.log" if fs.exists(single) else logs.log_path(self.log_dir, job_id), offset)

    # Sources and the whole library

    def source_list(self, path: str = "") -> dict[str, DataFrame]:
        """The folders above and the entries of a folder, as they are; a file has none."""
        path = path.removeprefix("./")
        chain = self.spark.range(1).select(F.explode(filesystem.crumbs(F.lit(path))).alias("c")).select("c.*")
        return {"chain": chain, "children": filesystem.entries(self.spark, f"{self.source_dir}/{path.strip('/')}")}

    def source_get_size(self, path: str = "") -> DataFrame:
        path = path.removeprefix("./")
        return filesystem.total_size(self.spark, f"{self.source_dir}/{path.strip('/')}", every=True)

    def device_list(self, devices: Iterable[str]) -> DataFrame:
        """Known drives, each once, in order."""
        return self.spark.createDataFrame([(d,) for d in sorted(set(devices))], "device string")

    def library_export(self, names: Iterable[str] = ("file", "tape", "position")) -> DataFrame:
        return catalog_json.export_document({"file": self.files, "tape": self.tapes, "position": self.positions}, names)

    def library_import(self, path: str) -> None:
        """Replaces each table that the document has, all in one commit."""
        self.catalog.commit(catalog_json.import_document(self.spark, path))

    def library_trim(self, trim_positions: bool = True, trim_files: bool = True) -> None:
        files, positions = trim.trim(self.files, self.positions, self.tapes, trim_positions, trim_files)
        self.catalog.commit({"file": files, "position": positions})

    def add_tape(self, tape: DataFrame, tape_files: DataFrame) -> DataFrame:
        """One more tape with its files, linked by content at once; returns the clashes."""
        tapes, positions = mutations.create_tape(self.tapes, self.positions, tape, tape_files)
        positions = cut(positions)
        files, positions, clashes = trim.link_new_positions(self.files, positions, tapes)
        clashes = cut(clashes)
        self.catalog.commit({"tape": tapes, "file": files, "position": positions})
        return clashes
