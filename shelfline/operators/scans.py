"""Scans, lookups, filters, ordering and pages over the catalog tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import paths, values
from shelfline.schema import UNLINKED, VISIBLE_BELOW

LIST_LIMIT, SEARCH_LIMIT = 20, 100


class NotFound(LookupError):
    """A point lookup without a row."""


def full_scan(table: DataFrame, after: int = 0) -> DataFrame:
    """All rows with an id above the cursor, in order of id; ids at or below 0 are reserved."""
    return table.where(F.col("id") > after).orderBy("id")


def unlinked(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("file_id") == UNLINKED)


def multi_get(table: DataFrame, keys: Sequence | DataFrame, column: str = "id") -> DataFrame:
    """Rows whose key is among the keys: a predicate that reaches the scan for a list, a semi join for a table of keys."""
    if isinstance(keys, DataFrame):
        return table.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")
    return table.where(F.col(column).isin(list(dict.fromkeys(keys)))) if keys else table.limit(0)


def get(table: DataFrame, key: int, column: str = "id") -> DataFrame:
    """The row with the key, as a DataFrame of one row; raises NotFound."""
    found = table.where(F.col(column) == key)
    if found.isEmpty():
        raise NotFound(f"{column} {key}")
    return found


def positions_by_file(positions: DataFrame, file_ids: Sequence | DataFrame) -> DataFrame:
    """``(file_id, positions)``: each file's positions as an array in order of id."""
    rows = multi_get(positions, file_ids, "file_id")
    rest = [c for c in positions.columns if c not in ("file_id", "id")]
    return rows.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("id", *rest))).alias("positions"))


def by_name(files: DataFrame, parent_id: int, name: str) -> DataFrame:
    return files.where((F.col("parent_id") == parent_id) & (F.col("name") == name))


def children(files: DataFrame, parent_id: int) -> DataFrame:
    """In byte order of the names."""
    return files.where(F.col("parent_id") == parent_id).orderBy("name")


def under_prefix(table: DataFrame, prefix: str, column: str = "path") -> DataFrame:
    """An exact byte prefix: no wildcard has a meaning, and the predicate reaches the Parquet scan."""
    return table.where(F.col(column).startswith(prefix))


def search_name(files: DataFrame, text: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Names that contain the text, upper and lower case told apart; by name, then id."""
    return files.where(F.col("name").contains(text)).orderBy("name", "id").limit(limit)


def page(table: DataFrame, *order: Column, limit: int | None = LIST_LIMIT, offset: int = 0) -> DataFrame:
    """A page in a total order; the limit is taken per partition first, so only pages meet."""
    rows = table.orderBy(*order)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def list_tapes(tapes: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    return page(tapes, F.desc("create_time"), F.asc("id"), limit=LIST_LIMIT if limit is None else limit, offset=offset or 0)


def list_jobs(jobs: DataFrame, status: int | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Newest first; without a status all visible ones."""
    chosen = jobs.where(F.col("status") == status) if status is not None else jobs.where(F.col("status") < VISIBLE_BELOW)
    return page(chosen, F.desc("create_time_ns"), F.asc("id"), limit=LIST_LIMIT if limit is None else limit, offset=offset or 0)


def recent_jobs(jobs: DataFrame, after_ns: int | None = None, after_id: int | None = None, limit: int | None = None) -> DataFrame:
    """The change feed, oldest change first, deleted jobs included.

    With ``after_id`` the cursor is (time, id), so jobs that share a time are never skipped."""
    chosen = jobs
    if after_ns is not None:
        later = F.col("update_time_ns") > after_ns
        if after_id is not None:
            later = later | (F.col("update_time_ns") == after_ns) & (F.col("id") > after_id)
        chosen = jobs.where(later)
    return page(chosen, F.asc("update_time_ns"), F.asc("id"), limit=LIST_LIMIT if limit is None else limit)


def next_job(jobs: DataFrame, status: int = 2) -> DataFrame:
    """The pending job of highest priority, the oldest of these."""
    return page(jobs.where(F.col("status") == status), F.desc("priority"), F.asc("create_time_ns"), F.asc("id"), limit=1)


def merge_feed(local: DataFrame, changes: DataFrame) -> DataFrame:
    """The list after a page of changes: of each id the row with the latest update, a change before a local row."""
    rows = local.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in local.columns if c != "id"]
    latest = rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("update_time_ns", "_new")).alias("r"))
    return latest.select("id", "r.*").select(*local.columns)


def feed_cursor(feed: DataFrame) -> DataFrame:
    return feed.agg(F.max("update_time_ns").alias("cursor"))


def wire_times(table: DataFrame, seconds: Sequence[str] = (), nanos: Sequence[str] = ()) -> DataFrame:
    """Times as Unix seconds or nanoseconds; null stays null."""
    return table.withColumns({c: values.to_seconds(F.col(c)) for c in seconds} | {c: values.to_nanos(F.col(c)) for c in nanos})


def file_view(files: DataFrame, with_size: bool = False) -> DataFrame:
    """What a file browser shows: extension, hidden flag, size (of directories only if asked for)."""
    from shelfline.schema import is_dir, permission

    name, folder = F.col("name"), is_dir(F.col("mode"))
    size = F.col("size") if with_size else F.when(~folder, F.col("size"))
    return files.select("id", "parent_id", "name", F.when(~folder, paths.extension(name)).otherwise("").alias("ext"), paths.hidden(name).alias("is_hidden"), folder.alias("is_dir"), size.alias("size"), permission(F.col("mode")).alias("permission"))


def selection_size(selected: DataFrame) -> DataFrame:
    """The total size, and whether the size of any selected row is unknown."""
    return selected.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.coalesce(F.bool_or(F.col("size").isNull()), F.lit(False)).alias("has_unknown"))


def file_detail(file: DataFrame, positions: DataFrame, tapes: DataFrame) -> DataFrame:
    """Each file with each of its positions on a known tape; files without any once, and nothing for the root."""
    placed = positions.where(F.col("file_id") != UNLINKED).select("file_id", F.col("id").alias("position_id"), "tape_id", "path", "write_time")
    placed = placed.join(tapes.select(F.col("id").alias("tape_id"), "barcode"), "tape_id")
    return file.join(placed, file["id"] == placed["file_id"], "left").drop("file_id")
