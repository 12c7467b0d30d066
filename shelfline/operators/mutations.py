"""Catalog changes as functions from snapshots to snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import values
from shelfline.operators.scans import multi_get
from shelfline.plans.stages import cut
from shelfline.plans.tree import ancestors, descendants, holds_files
from shelfline.plans.trim import ensure_directories, numbered
from shelfline.schema import DIR_BIT, JOB_STATUS, PERMISSION_BITS, ROOT_ID, TRASH_ID, UNLINKED, is_dir


def without(table: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """The table without the rows of these ids."""
    if isinstance(ids, DataFrame):
        return table.join(ids.select("id"), "id", "left_anti").select(*table.columns)
    return table.where(~F.col("id").isin(list(ids))) if ids else table


delete_tapes = without
delete_positions = without


def upsert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of the same id."""
    return without(table, rows.select("id")).unionByName(rows.select(*table.columns))


def create_tape(tapes: DataFrame, positions: DataFrame, tape: DataFrame, tape_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tapes, positions)`` with one more tape and an unlinked position for each of its files.

    The tape's written bytes are the files' sum, and its capacity that too where it is 0 or null."""
    total = tape_files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_sum"))
    row = tape.crossJoin(F.broadcast(total)).withColumns({"writen_bytes": F.col("_sum"), "capacity_bytes": F.coalesce(F.nullif("capacity_bytes", F.lit(0)), "_sum")}).select(*tapes.columns)
    tape_id = row.first()["id"]
    first = positions.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(tape_files.withColumns({"file_id": F.lit(UNLINKED).cast("long"), "tape_id": F.lit(tape_id).cast("long")}), first, "path", "write_time", "size")
    return upsert(tapes, row), positions.unionByName(new.select(*positions.columns))


def make_directories(files: DataFrame, wanted: DataFrame, parent_id: int = ROOT_ID, mode: int = PERMISSION_BITS) -> tuple[DataFrame, DataFrame]:
    return ensure_directories(files, wanted, parent_id, mode)


def move(files: DataFrame, file_id: int, parent_id: int, name: str) -> DataFrame:
    """One file or directory under a new parent and name.

    A directory that meets one of the same name is merged into it, level by level: children move, and the later
    modification time stays. Any other clash is an error, as is a move below itself; a move to its own place does nothing."""
    row = files.where(F.col("id") == file_id).first()
    if row is None:
        raise FileNotFoundError(file_id)
    if (row["parent_id"], row["name"]) == (parent_id, name):
        return files
    at, seen = parent_id, set()
    while at != ROOT_ID and at not in seen:  # point lookups up to the root, one a level
        if at == file_id:
            raise ValueError("a directory can't move below itself")
        seen.add(at)
        above = files.where(F.col("id") == at).select("parent_id").first()
        at = ROOT_ID if above is None else above["parent_id"]
    # (mover, its new parent, its new name), level by level
    todo = files.where(F.col("id") == file_id).select("id", F.lit(parent_id).cast("long").alias("_to"), F.lit(name).alias("_name"))
    moved, gone, times = None, None, None
    while True:
        mine = files.join(todo, "id").select("id", "mode", "mod_time", "_to", "_name")
        there = files.select(F.col("id").alias("_there"), F.col("parent_id").alias("_to"), F.col("name").alias("_name"), F.col("mode").alias("_mode"), F.col("mod_time").alias("_time"))
        met = cut(mine.join(there, ["_to", "_name"], "left"))
        clash = F.col("_there").isNotNull()
        if not met.where(clash & ~(is_dir(F.col("mode")) & is_dir(F.col("_mode")))).isEmpty():
            raise FileExistsError(name)
        free = met.where(~clash).select("id", "_to", "_name")
        merged = met.where(clash)
        moved = free if moved is None else moved.unionByName(free)
        gone = merged.select("id") if gone is None else gone.unionByName(merged.select("id"))
        late = merged.select(F.col("_there").alias("id"), F.greatest("mod_time", "_time").alias("_late"))
        times = late if times is None else times.unionByName(late)
        todo = cut(files.join(merged.select(F.col("id").alias("_from"), "_there"), files["parent_id"] == F.col("_from")).select(files["id"], F.col("_there").alias("_to"), F.col("name").alias("_name")))
        if todo.isEmpty():
            break
    out = files.join(gone, "id", "left_anti").join(moved, "id", "left").join(times.groupBy("id").agg(F.max("_late").alias("_late")), "id", "left")
    return out.withColumns({"parent_id": F.coalesce("_to", "parent_id"), "name": F.coalesce("_name", "name"), "mod_time": F.coalesce("_late", "mod_time")}).select(*files.columns)


def edit(files: DataFrame, file_id: int, parent_id: int | None = None, name: str | None = None) -> DataFrame:
    """A new parent, a new name, or both; a name with slashes makes the directories it names first."""
    row = files.where(F.col("id") == file_id).first()
    if row is None:
        raise FileNotFoundError(file_id)
    to, new = row["parent_id"] if parent_id is None else parent_id, row["name"]
    if name is not None:
        parts = [p.strip() for p in name.strip().replace("\\", "/").split("/") if p.strip()]
        if not parts:
            raise ValueError("a file needs a name")
        new = parts[-1]
        if len(parts) > 1:
            wanted = files.sparkSession.createDataFrame([("/".join(parts[:-1]),)], "path string")
            files, where = ensure_directories(files, wanted, to)
            files = cut(files)
            to = where.first()["parent_id"]
    return move(files, file_id, to, new)


def delete(files: DataFrame, ids: Sequence[int], now: Column) -> DataFrame:
    """What lies outside the trash moves to a folder there that is named by the time; a directory inside goes for good
    if no file is left in it, and files never do."""
    ids = list(dict.fromkeys(ids))
    chosen = multi_get(files, ids).select("id")
    line = ancestors(files, chosen)
    trashed = cut(line.groupBy("start").agg(F.bool_or((F.col("id") == TRASH_ID) | (F.col("parent_id") == TRASH_ID)).alias("_in")).select(F.col("start").alias("id"), "_in"))
    inside = files.join(trashed.where("_in"), "id").where(is_dir(F.col("mode")) & (F.col("id") != TRASH_ID)).select(F.col("id").alias("root"))
    empty = cut(holds_files(files, inside).where(~F.col("holds_files")).select("root"))
    purged = empty.select(F.col("root").alias("id")).unionByName(descendants(files, empty).select("id")).distinct()
    out = cut(files.join(purged, "id", "left_anti").select(*files.columns))
    outside = [r["id"] for r in trashed.where(~F.col("_in")).select("id").collect()]  # at most the ids asked for
    if not outside:
        return out
    stamp = out.sparkSession.range(1).select(values.rfc3339(now).alias("t")).first()["t"]
    if out.where(F.col("id") == TRASH_ID).isEmpty():
        trash = out.sparkSession.range(1).select(F.lit(TRASH_ID).cast("long").alias("id"), F.lit(ROOT_ID).cast("long").alias("parent_id"), F.lit(".Trash").alias("name"), F.lit(DIR_BIT | PERMISSION_BITS).alias("mode"), now.cast(dict(files.dtypes)["mod_time"]).alias("mod_time"), F.lit(None).cast("binary").alias("hash"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("signature"))
        out = out.unionByName(trash.select(*files.columns))
    out, where = ensure_directories(out, out.sparkSession.createDataFrame([(stamp,)], "path string"), TRASH_ID)
    out = cut(out)
    folder = where.first()["parent_id"]
    for one in outside:
        row = out.where(F.col("id") == one).first()
        if row is not None:
            out = cut(move(out, one, folder, row["name"]))
    return out


def delete_jobs(jobs: DataFrame, ids: Sequence[int], now_ns: Column) -> DataFrame:
    """Jobs stay as tombstones."""
    hit = F.col("id").isin(list(ids))
    return jobs.withColumns({"status": F.when(hit, JOB_STATUS["DELETED"]).otherwise(F.col("status")), "update_time_ns": F.when(hit, now_ns).otherwise(F.col("update_time_ns"))})


def save_jobs(jobs: DataFrame, rows: DataFrame, now_ns: Column) -> DataFrame:
    """An upsert that stamps the update time, and the creation time where it is 0 or null."""
    stamped = rows.withColumns({"update_time_ns": now_ns, "create_time_ns": F.coalesce(F.nullif("create_time_ns", F.lit(0)), now_ns)})
    return upsert(jobs, stamped)


def edit_job_state(jobs: DataFrame, job_id: int, status: int | None, state: Column | None, now_ns: Column) -> DataFrame:
    """Replaces a job's state as a whole, null where none is given; a job that is being processed can't be edited, nor set so."""
    row = jobs.where(F.col("id") == job_id).first()
    if row is None:
        raise LookupError(job_id)
    if JOB_STATUS["PROCESSING"] in (row["status"], status):
        raise ValueError("a job that is being processed can't be edited")
    hit = F.col("id") == job_id
    kind = jobs.schema["state"].dataType
    new = F.lit(None).cast(kind) if state is None else state.cast(kind)
    return jobs.withColumns({"status": F.when(hit & F.lit(status is not None), F.lit(status)).otherwise(F.col("status")).cast("int"), "state": F.when(hit, new).otherwise(F.col("state")), "update_time_ns": F.when(hit, now_ns).otherwise(F.col("update_time_ns"))})


def append_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


