"""Source folders: listing, sizes and recursive walks, and breadcrumbs of a path.

Spark's own readers skip names that begin with ``_`` or ``.``, so the folders are listed by other means: on the machines'
file system by tasks, folder by folder, and elsewhere by the driver through Hadoop's file system.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions import paths

#: Files that no archive takes.
SKIPPED = [".DS_Store"]
#: Folders a walk is dealt to tasks by, at least where there are so many.
FOLDERS = 64
SCHEMA = "path string, size long, seconds double"


def _files(entries: Iterator[os.DirEntry], base: str) -> Iterator[tuple[str, int, float]]:
    for e in entries:
        if e.is_file():
            yield os.path.relpath(e.path, base), e.stat().st_size, e.stat().st_mtime


def _below(folder: str, deep: bool, base: str) -> Iterator[tuple[str, int, float]]:
    """The files of a folder, and if ``deep`` of those below it."""
    open_ = [folder]
    while open_:
        with os.scandir(open_.pop()) as it:
            entries = list(it)
        yield from _files(entries, base)
        open_ += [e.path for e in entries if deep and e.is_dir()]


def _dealt(base: str) -> list[tuple[str, bool]]:
    """Folders that together hold all files once: those above alone, the lowest ones with all below them."""
    above, level = [], [base]
    while level and len(level) < FOLDERS:
        above += level
        lower = []
        for folder in level:
            with os.scandir(folder) as it:
                lower += [e.path for e in it if e.is_dir()]
        level = lower
    return [(f, False) for f in above] + [(f, True) for f in level]


def _local(spark: SparkSession, base: str) -> DataFrame:
    if os.path.isfile(base):
        s = os.stat(base)
        return spark.createDataFrame([(os.path.basename(base), s.st_size, s.st_mtime)], SCHEMA)
    dealt = _dealt(base)
    return spark.createDataFrame(spark.sparkContext.parallelize(dealt, min(len(dealt), FOLDERS)).flatMap(lambda f: _below(*f, base)), SCHEMA)


def _remote(spark: SparkSession, fs, root) -> DataFrame:
    found, rows = fs.listFiles(root, True), []
    base = fs.getFileStatus(root).getPath().toUri().getPath().rstrip("/")
    while found.hasNext():
        f = found.next()
        path = f.getPath().toUri().getPath()
        rows.append((path[len(base) + 1 :] or f.getPath().getName(), f.getLen(), f.getModificationTime() / 1000))
    return spark.createDataFrame(rows, SCHEMA)


def every_file(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, mod_time)`` of all files below a folder, hidden ones too, paths from it on; contents are never read.

    Links are followed; what is no regular file, such as a link to nothing, is left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    rows = _local(spark, at.toUri().getPath()) if fs.getUri().getScheme() == "file" else _remote(spark, fs, at)
    return rows.select("path", "size", F.timestamp_micros((F.col("seconds") * 1000000).cast("long")).alias("mod_time"))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """The files below a folder that an archive takes: all but those of ``SKIPPED`` names."""
    return every_file(spark, root).where(~paths.basename(F.col("path")).isin(SKIPPED))


def sources(spark: SparkSession, root: str) -> DataFrame:
    """The walk as sources: path segments, in order."""
    return walk(spark, root).select(F.split("path", "/").alias("path"), "size", "mod_time").orderBy("path")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """One level: files as they are, folders (that hold a file) with the sum below them."""
    rows = walk(spark, root).withColumn("name", F.substring_index("path", "/", 1)).withColumn("is_dir", F.col("path").contains("/"))
    return rows.groupBy("name", "is_dir").agg(F.sum("size").alias("size"), F.max("mod_time").alias("mod_time")).orderBy("name")


def entries(spark: SparkSession, root: str) -> DataFrame:
    """``(name, is_dir, size, mod_time)`` of what lies right in a folder, in order of name: hidden names and empty folders too.

    One listing of one folder, nothing below it is looked at; a file has no entries."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.listStatus(at) if fs.getFileStatus(at).isDirectory() else []
    rows = [(f.getPath().getName(), f.isDirectory(), f.getLen(), f.getModificationTime()) for f in found]
    return spark.createDataFrame(rows, "name string, is_dir boolean, size long, millis long").select("name", "is_dir", "size", F.timestamp_millis("millis").alias("mod_time")).orderBy("name")


def total_size(spark: SparkSession, root: str, every: bool = False) -> DataFrame:
    """The sum of the walk, or of every file below the folder."""
    return (every_file if every else walk)(spark, root).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def crumbs(path: Column) -> Column:
    """``(path, parent_path, name)`` of the root and each segment; the first is named Root and lies at ``./``."""
    parts = paths.segments(path)
    upto = lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))
    root = F.array(F.struct(F.lit("./").alias("path"), F.lit("").alias("parent_path"), F.lit("Root").alias("name")))
    rest = F.transform(parts, lambda s, i: F.struct(upto(i + 1).alias("path"), F.when(i == 0, F.lit("./")).otherwise(upto(i)).alias("parent_path"), s.alias("name")))
    return F.concat(root, rest)
