"""Directory listing of a tape: one row for each name under a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions import paths
from shelfline.operators.scans import under_prefix
from shelfline.schema import DIR_BIT, PERMISSION_BITS


def tape_directory(positions: DataFrame, tape_id: int, directory: str = "") -> DataFrame:
    """Positions right under the directory as they are, and one row for each directory below it.

    A directory's row has the sum of the sizes and the latest times of all that lies in it. Tape and prefix are
    predicates of the scan, and the sums are taken before the shuffle; the shuffle carries a row for each name."""
    prefix = directory.strip("/") + "/" if directory.strip("/") else ""
    rows = under_prefix(positions.where(F.col("tape_id") == tape_id), prefix)
    rows = rows.withColumn("_next", paths.next_segment(F.col("path"), prefix)).where(F.col("_next") != "")
    below = F.col("_next").endswith("/")
    files = rows.where(~below).select("id", "file_id", "tape_id", "path", "mode", "mod_time", "write_time", "size", "hash")
    folders = rows.where(below).groupBy("tape_id", "_next").agg(F.sum("size").alias("size"), F.max("mod_time").alias("mod_time"), F.max("write_time").alias("write_time"))
    folders = folders.select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("file_id"), "tape_id", F.concat(F.lit(prefix), "_next").alias("path"), F.lit(DIR_BIT | PERMISSION_BITS).alias("mode"), "mod_time", "write_time", "size", F.lit(None).cast("binary").alias("hash"))
    return files.unionByName(folders).orderBy(paths.order_key(F.col("path")), "id")
