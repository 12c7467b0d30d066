"""The virtual file tree: closures, usage, paths.

Rounds follow the depth of the tree, each a join on ids. Only directories go on to the next round, and lineage is cut
between rounds. A tree deeper than ``MAX_DEPTH`` is reported, which also ends a cycle of parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import paths
from shelfline.plans.stages import cut, meeting
from shelfline.schema import ROOT_ID, is_dir

MAX_DEPTH, MAX_ANCESTORS = 100, 32


class TooDeep(ValueError):
    """The tree is deeper than allowed, or holds a cycle."""


def descendants(files: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH, carry: Column | None = None, extend: Column | None = None) -> DataFrame:
    """All rows below the roots ``(root)``, as ``(root, depth from 1, *file columns)``.

    ``carry`` starts a column ``carried`` at the roots, which have the columns of ``roots``; ``extend`` makes a child's value from its
    parent's ``carried`` and its own name. Only directories, with their names, go through the rounds; all files meet
    the directories they lie in by one join at the end. A root that lies below itself is reported at once."""
    extra = ["carried"] if carry is not None else []
    value = [extend.alias("carried")] if extra else []
    folders = cut(files.where(is_dir(F.col("mode"))).select("id", "parent_id", "name"))
    level = roots.select("root", F.col("root").alias("_at"), F.lit(0).alias("_above"), *([carry.alias("carried")] if extra else []))
    heads, depth = level, 0
    while True:
        depth += 1
        level = cut(level.join(folders, folders["parent_id"] == level["_at"]).select("root", F.col("id").alias("_at"), F.lit(depth).alias("_above"), *value))
        n, round_ = level.agg(F.count("*"), F.bool_or(F.col("_at") == F.col("root"))).first()
        if not n:
            break
        if depth > max_depth or round_:
            raise TooDeep(f"more than {max_depth} levels, or a directory below itself")
        heads = heads.unionByName(level)
    out = heads.join(files, files["parent_id"] == heads["_at"]).select("root", (F.col("_above") + 1).alias("depth"), *files.columns, *value)
    if depth > max_depth and not (out := cut(out)).where(F.col("depth") > max_depth).isEmpty():
        raise TooDeep(f"more than {max_depth} levels")
    return out


def found_paths(files: DataFrame, wanted: DataFrame, parent_id: int = ROOT_ID) -> DataFrame:
    """``(path, id, mode)`` of those of the clean paths ``(path)``, and of all their prefixes, that exist below a parent.

    Files that bear a wanted name are taken out of the tree once; then each level of the paths meets them by parent and
    name. So what is looked up costs one pass over the files, not the paths of the whole tree."""
    parts = F.split("path", "/")
    upto = F.transform(parts, lambda s, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    needed = cut(wanted.select(F.explode(upto).alias("path")).distinct().select("path", F.size(F.split("path", "/")).alias("n"), paths.basename(F.col("path")).alias("name"), F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("above")))
    levels = needed.agg(F.max("n")).first()[0] or 0
    known = cut(files.select("id", "parent_id", "name", "mode").join(needed.select("name").distinct(), "name", "left_semi"))
    above = files.sparkSession.range(1).select(F.lit("").alias("above"), F.lit(parent_id).cast("long").alias("parent_id"))
    out = None
    for n in range(1, levels + 1):
        level = needed.where(F.col("n") == n).join(above, "above").join(known, ["parent_id", "name"]).groupBy("path").agg(F.min(F.struct("id", "mode")).alias("f")).select("path", "f.*")
        level = cut(level)
        if n < levels and level.isEmpty():  # nothing lies below what isn't there
            break
        out = level if out is None else out.unionByName(level)
        above = level.select(F.col("path").alias("above"), F.col("id").alias("parent_id"))
    return out if out is not None else known.select(F.col("name").alias("path"), "id", "mode").limit(0)


def ancestors(files: DataFrame, ids: DataFrame, max_levels: int = MAX_ANCESTORS) -> DataFrame:
    """``(start, steps, *file columns)``: each id ``(id)`` and its ancestors; order by steps descending for the root first.

    At most ``max_levels`` rows a start; the virtual root gives none. A chain that ends at a missing parent has the column
    ``broken`` true in all its rows. Only the distinct parents of the starts climb, level by level; their chains, of at
    most ``max_levels`` rows each, meet the starts by one join at the end."""
    row = F.struct(*files.columns)
    chosen = cut(ids.select(F.col("id").alias("_at")).where(F.col("_at") != ROOT_ID).distinct())
    own = files.join(meeting(chosen, chosen.count()), files["id"] == F.col("_at"), "left_semi").select(F.col("id").alias("start"), F.col("parent_id").alias("_up"), row.alias("own"))
    own = cut(own)
    level = cut(own.where(F.col("_up") != ROOT_ID).select(F.col("_up").alias("top")).distinct().withColumn("_at", F.col("top")))
    line = None
    for steps in range(1, max_levels):
        n = level.count()
        if not n:
            break
        found = cut(files.join(meeting(level, n), files["id"] == F.col("_at")).select("top", F.lit(steps).alias("steps"), F.col("parent_id").alias("_up"), row.alias("f")))
        line = found if line is None else line.unionByName(found)
        level = found.where(F.col("_up") != ROOT_ID).select("top", F.col("_up").alias("_at"))
    first = F.struct(F.lit(0).alias("steps"), F.col("_up"), F.col("own").alias("f"))
    if line is None:
        chained = own.select("start", F.array(first).alias("chain"))
    else:
        chains = cut(line.groupBy("top").agg(F.collect_list(F.struct("steps", "_up", "f")).alias("rest")))
        met = own.join(meeting(chains, chains.count()), F.col("_up") == F.col("top"), "left")
        chained = met.select("start", F.when(F.col("rest").isNull(), F.array(first)).otherwise(F.concat(F.array(first), "rest")).alias("chain"))
    last = F.array_max(F.transform("chain", lambda x: F.struct(x["steps"], x["_up"])))["_up"]
    broken = (last != ROOT_ID) & (F.size("chain") < max_levels)
    return chained.select("start", broken.alias("broken"), F.explode("chain").alias("c")).select("start", "c.steps", "c.f.*", "broken")


def directory_usage(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(id, total_size, total_files)`` of every directory, the root among them: the sizes of all that lies below.

    Sizes are first summed by parent, so that after one shuffle of the files only directories move: level by level
    every directory's sum goes to its parent. That costs the sum of the directories' depths, not of the files'."""
    folder = is_dir(F.col("mode"))
    own = files.groupBy(F.col("parent_id").alias("at")).agg(F.sum("size").alias("amount"), F.sum(F.when(~folder, 1).otherwise(0)).alias("n"))
    folders = cut(files.where(folder).select("id", "parent_id"))
    up = cut(own)
    parts, depth = [up], 0
    while True:
        depth += 1
        up = cut(up.join(folders, up["at"] == folders["id"]).groupBy(F.col("parent_id").alias("at")).agg(F.sum("amount").alias("amount"), F.sum("n").alias("n")))
        if up.isEmpty():
            break
        if depth > max_depth:
            raise TooDeep(f"more than {max_depth} levels")
        parts.append(up)
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    total = total.groupBy("at").agg(F.sum("amount").alias("total_size"), F.sum("n").alias("total_files"))
    every = folders.select("id").unionByName(files.sparkSession.range(1).select(F.lit(ROOT_ID).cast("long").alias("id"))).distinct()
    return every.join(total, every["id"] == total["at"], "left").select("id", F.coalesce("total_size", F.lit(0)).alias("total_size"), F.coalesce("total_files", F.lit(0)).alias("total_files"))


def usage_below(files: DataFrame, parent_id: int) -> DataFrame:
    """The children of one directory in order of name, directories with the size of all that lies in them."""
    kids = files.where(F.col("parent_id") == parent_id)
    below = descendants(files, kids.where(is_dir(F.col("mode"))).select(F.col("id").alias("root")))
    total = below.groupBy("root").agg(F.sum("size").alias("below"))
    return kids.join(total, kids["id"] == total["root"], "left").withColumn("size", F.col("size") + F.coalesce("below", F.lit(0))).drop("root", "below").orderBy("name")


def holds_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, holds_files)``: whether a subtree has anything that is no directory; a root that has can't be purged."""
    below = descendants(files, roots).groupBy("root").agg(F.bool_or(~is_dir(F.col("mode"))).alias("any"))
    return roots.join(below, "root", "left").select("root", F.coalesce("any", F.lit(False)).alias("holds_files"))


def full_paths(files: DataFrame) -> DataFrame:
    """``(id, full_path, depth)`` of every file that hangs on the root: built once a snapshot, for all lookups by path."""
    root = files.sparkSession.range(1).select(F.lit(ROOT_ID).cast("long").alias("root"))
    out = descendants(files, root, carry=F.lit(""), extend=F.concat(F.col("carried"), F.when(F.col("carried") == "", "").otherwise("/"), F.col("name")))
    return out.select("id", F.col("carried").alias("full_path"), "depth")


def resolve(files: DataFrame, wanted: DataFrame, parent_id: int = ROOT_ID) -> DataFrame:
    """``(path, id)`` of each wanted ``(path)`` below a parent; null where there is none or the path has a backslash."""
    key = F.array_join(paths.segments(paths.clean(F.col("path"))), "/")
    named = wanted.withColumn("_key", F.when(~F.col("path").contains("\\"), F.regexp_replace(key, r"^\.$", "")))
    known = found_paths(files, named.where("_key is not null and _key <> ''").select(F.col("_key").alias("path")), parent_id)
    found = named.join(known.select(F.col("path").alias("_key"), "id"), "_key", "left")
    return found.select("path", F.when(F.col("_key") == "", F.lit(parent_id).cast("long")).otherwise(F.col("id")).alias("id"))
