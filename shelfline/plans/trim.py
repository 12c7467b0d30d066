"""Trimming the library, and linking new positions to files by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions import paths, values
from shelfline.plans.stages import cut
from shelfline.plans.tree import found_paths
from shelfline.schema import DIR_BIT, PERMISSION_BITS, ROOT_ID, UNLINKED, is_dir, is_regular


def orphan_positions(positions: DataFrame, tapes: DataFrame) -> DataFrame:
    """Positions whose tape is gone."""
    return positions.join(tapes, positions["tape_id"] == tapes["id"], "left_anti")


def files_without_position(files: DataFrame, positions: DataFrame) -> DataFrame:
    """Regular files of which no copy is left."""
    return files.where(is_regular(F.col("mode"))).join(positions, files["id"] == positions["file_id"], "left_anti")


def superseded_positions(positions: DataFrame, files: DataFrame) -> DataFrame:
    """Older positions of a regular file at one place of a tape: all but the last written, of these all but the lowest id.

    The latest of each place is found by a pre-aggregated grouping and joined back, so no place is sorted in one task."""
    mine = positions.join(files.where(is_regular(F.col("mode"))), positions["file_id"] == files["id"], "left_semi")
    place = ["file_id", "tape_id", "path"]
    latest = mine.groupBy(*place).agg(F.max("write_time").alias("_latest"), F.count("*").alias("_n")).where("_n > 1")
    again = mine.join(latest, place).withColumn("_keeps", F.col("write_time").eqNullSafe(F.col("_latest")))
    winner = again.where("_keeps").groupBy(*place).agg(F.min("id").alias("_winner"))
    return again.join(winner, place).where(F.col("id") != F.col("_winner")).select(*positions.columns)


def trim(files: DataFrame, positions: DataFrame, tapes: DataFrame, trim_positions: bool = True, trim_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(files, positions)`` after a trim. Without the position step nothing happens, whatever the other switch says.

    Positions of deleted tapes go first, then older ones of one place, then files that are left without a position."""
    if not trim_positions:
        return files, positions
    left = positions.join(tapes, positions["tape_id"] == tapes["id"], "left_semi")
    if not trim_files:
        return files, left
    left = left.join(superseded_positions(left, files).select("id"), "id", "left_anti").select(*positions.columns)
    gone = files_without_position(files, left).select("id")
    return files.join(gone, "id", "left_anti").select(*files.columns), left


def with_signature(positions: DataFrame) -> DataFrame:
    return positions.withColumn("_signature", values.signature(F.col("hash"), F.col("size")))


def linked_positions(positions: DataFrame, files: DataFrame) -> DataFrame:
    """Unlinked positions whose content a file has, with that file's id: the lowest of equal contents."""
    known = files.where("signature is not null and length(signature) > 0").groupBy(F.col("signature").alias("_signature")).agg(F.min("id").alias("_file"))
    found = with_signature(positions.where(F.col("file_id") == UNLINKED)).join(known, "_signature")
    return found.withColumn("file_id", F.col("_file")).select(*positions.columns)


def unmatched_positions(positions: DataFrame, files: DataFrame, tapes: DataFrame) -> DataFrame:
    """Unlinked positions on a known tape whose content no file has, with their barcode and where their file shall lie."""
    open_ = with_signature(positions.where((F.col("file_id") == UNLINKED) & F.col("hash").isNotNull()))
    known = files.where("signature is not null").select(F.col("signature").alias("_signature"))
    open_ = open_.join(known, "_signature", "left_anti").join(tapes.select(F.col("id").alias("tape_id"), "barcode"), "tape_id")
    return open_.withColumn("target", F.concat_ws("/", F.lit("Unforged"), "barcode", paths.clean(F.col("path"))))


def link_new_positions(files: DataFrame, positions: DataFrame, tapes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(files, positions, clashes)``: all unlinked positions linked in one pass.

    Equal contents share one new file, placed by the position with the lowest id; new ids follow the largest one in the order
    of the targets. A target that exists is a clash: its positions stay unlinked. So do positions on unknown tapes."""
    linked = linked_positions(positions, files)
    open_ = unmatched_positions(positions, files, tapes)
    owner = open_.groupBy("_signature").agg(F.min_by(F.struct("target", "mode", "mod_time", "hash", "size", F.col("id").alias("owner")), "id").alias("o")).select("_signature", "o.*")
    owner = cut(owner)
    # of two contents with one target the later one clashes
    first = owner.groupBy("target").agg(F.min("owner").alias("_first"))
    folder = F.regexp_replace("target", "/[^/]*$", "")
    # the targets, and their directories as ensure_directories names them
    known = found_paths(files, owner.select(F.col("target").alias("path")).unionByName(owner.select(F.array_join(paths.segments(folder), "/").alias("path")).where("path <> ''")))
    taken = known.select(F.col("path").alias("target"), F.col("id").alias("_taken"))
    owner = cut(owner.join(first, "target").join(taken, "target", "left").withColumn("_clash", F.col("_taken").isNotNull() | (F.col("owner") > F.col("_first"))))
    clashes = owner.where("_clash").select("target", "owner")
    new = owner.where(~F.col("_clash"))
    files_with_dirs, where = ensure_directories(files, new.select(folder.alias("path")).distinct(), known=known)
    first = files_with_dirs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = new.withColumn("path", folder).join(where, "path")
    new = numbered(new, first, "target")
    made = new.select("id", "parent_id", paths.basename(F.col("target")).alias("name"), "mode", "mod_time", "hash", "size", F.col("_signature").alias("signature"))
    placed = open_.join(made.select(F.col("signature").alias("_signature"), F.col("id").alias("_file")), "_signature").withColumn("file_id", F.col("_file")).select(*positions.columns)
    moved = linked.unionByName(placed)
    rest = positions.join(moved.select("id"), "id", "left_anti").select(*positions.columns)
    return files_with_dirs.unionByName(made.select(*files.columns)), rest.unionByName(moved), clashes


def numbered(rows: DataFrame, after: int, *order: str) -> DataFrame:
    """Ids after the given one, in a total order: ranks within range partitions plus the partitions' starts, so no
    task sees all rows."""
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    counts = ranged.groupBy("_part").count().orderBy("_part").collect()  # a number for each partition
    starts, total = {}, after
    for r in counts:
        starts[r["_part"]], total = total, total + r["count"]
    if not starts:
        return ranged.withColumn("id", F.lit(after).cast("long")).drop("_part")
    start = F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)])
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("id", (start[F.col("_part")] + rank).cast("long")).drop("_part")


def ensure_directories(files: DataFrame, wanted: DataFrame, parent_id: int = ROOT_ID, mode: int = PERMISSION_BITS, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(files, where)``: the tree with every wanted directory ``(path)``, and ``(path, parent_id)`` with each one's own id.

    Missing segments are made with ids after the largest, in the order of their paths. A segment that exists as no
    directory is an error, as is an empty path. ``known`` is what found_paths tells of these paths, if that is known."""
    named = wanted.select("path", F.array_join(paths.segments(F.col("path")), "/").alias("_clean"))
    if not named.where(F.col("_clean") == "").isEmpty():
        raise ValueError("a directory needs a name")
    known = found_paths(files, named.select(F.col("_clean").alias("path")), parent_id) if known is None else known
    known = known.select(F.col("path").alias("_dir"), F.col("id").alias("_id"), "mode")
    needed = named.select(F.explode(paths.prefixes(F.col("_clean"))).alias("_dir")).distinct()
    if not needed.join(known.where(~is_dir(F.col("mode"))), "_dir", "left_semi").isEmpty():
        raise FileExistsError("a segment of the path is no directory")
    missing = needed.join(known, "_dir", "left_anti")
    first = max(0, files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    made = cut(numbered(missing, first, "_dir"))
    every = made.select("_dir", F.col("id").alias("_id")).unionByName(known.select("_dir", "_id"))
    above = made.withColumn("_above", F.when(F.col("_dir").contains("/"), F.regexp_replace("_dir", "/[^/]*$", "")).otherwise(""))
    placed = above.join(every.select(F.col("_dir").alias("_above"), F.col("_id").alias("_parent")), "_above", "left")
    new = placed.select("id", F.coalesce("_parent", F.lit(parent_id).cast("long")).alias("parent_id"), paths.basename(F.col("_dir")).alias("name"), F.lit(DIR_BIT | (mode & PERMISSION_BITS)).alias("mode"), F.current_timestamp().cast(dict(files.dtypes)["mod_time"]).alias("mod_time"), F.lit(None).cast("binary").alias("hash"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("signature"))
    where = named.join(every, named["_clean"] == every["_dir"]).select("path", F.col("_id").alias("parent_id"))
    return files.unionByName(new.select(*files.columns)), where
