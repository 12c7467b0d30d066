"""Queries of the archive catalog on the star-schema tables, each with DuckDB SQL of the same rows.

A query is a thin use of an operator; SQL never looks at an operator's output. Queries without SQL are listed in
``WITHOUT_SQL`` and tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline import derive as d
from shelfline.functions import cartridge, paths, values
from shelfline.operators import jobs as j
from shelfline.operators import listing, mutations, scans, telemetry
from shelfline.plans import restore, tree, trim
from shelfline.schema import COPY_STATUS, JOB_STATUS, enum_name, is_dir
from shelfline.sources import catalog_json, filesystem

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_VIEWS = {"tape": d.TAPE, "position": d.POSITION, "part_file": d.PART_FILE, "tree": d.TREE, "content": d.CONTENT, "job": d.JOB, "source": d.ARCHIVE, "live": d.LIVE, "progress": d.PROGRESS, "page_path": d.URL}


def query(sql: str | None = None, views: str = "", recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            heads = [_VIEWS[v] for v in views.split()]
            body = sql.strip()
            if body.upper().startswith("WITH "):
                heads.append(body[5:].split("\nSELECT", 1)[0].rstrip())
                body = "SELECT" + body[5:].split("\nSELECT", 1)[1]
            ORACLES[f.__name__] = ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(heads) + "\n" if heads else "") + body
        return f

    return add


# Directory listing, scans and pages


@query(
    """
SELECT min(id) AS id, path, CAST(sum(size) AS BIGINT) AS size, max(write_time) AS write_time
FROM (SELECT CASE WHEN instr(substr(path, 5), '/') > 0 THEN 0 ELSE id END AS id,
             'R/F/' || CASE WHEN instr(substr(path, 5), '/') > 0 THEN split_part(substr(path, 5), '/', 1) || '/' ELSE substr(path, 5) END AS path, size, write_time
      FROM position WHERE tape_id = 2 AND starts_with(path, 'R/F/'))
GROUP BY CASE WHEN id > 0 THEN id END, path""",
    "position",
)
def tape_dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.tape_directory(d.positions(spark, sf_dir), 2, "R/F").select("id", "path", "size", "write_time")


@query("SELECT id, path, size, write_time FROM position WHERE tape_id = 2 AND starts_with(path, 'A/F/1995/') AND NOT contains(substr(path, 10), '/')", "position")
def tape_dir_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.tape_directory(d.positions(spark, sf_dir), 2, "A/F/1995/").select("id", "path", "size", "write_time")


@query("SELECT id, name, size FROM part_file WHERE id > 100", "part_file")
def keyset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.full_scan(d.part_files(spark, sf_dir), 100).select("id", "name", "size")


@query("SELECT id, name FROM tree WHERE id IN (1, 3, 105, 1000007, -5)", "tree")
def multi_get_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.multi_get(d.tree(spark, sf_dir), [1, 3, 105, 1000007, 3, -5]).select("id", "name")


@query("SELECT id, barcode FROM tape_all WHERE barcode IN ('T00003', 'T00010', 'nope')", "tape")
def multi_get_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.multi_get(d.tapes(spark, sf_dir, live_only=False), ["T00003", "T00010", "nope"], "barcode").select("id", "barcode")


@query("SELECT file_id, count(*) AS n, min(id) AS first_id, CAST(sum(size) AS BIGINT) AS bytes FROM position WHERE file_id IN (SELECT id FROM part_file) GROUP BY file_id", "position part_file")
def positions_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = scans.positions_by_file(d.positions(spark, sf_dir), d.part_files(spark, sf_dir).select("id"))
    return grouped.select("file_id", F.size("positions").cast("long").alias("n"), F.col("positions")[0]["id"].alias("first_id"), F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p["size"]).alias("bytes"))


@query("SELECT id, path FROM (SELECT doc_id + 1 AS id, 'd/' || doc_id % 5 || '/doc' || doc_id AS path FROM content WHERE doc_id % 2 = 1)", "content")
def unlinked_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.unlinked(d.content_positions(spark, sf_dir)).select("id", "path")


@query("SELECT id, parent_id, name FROM tree WHERE parent_id = 101 AND name = (SELECT max(name) FROM tree WHERE parent_id = 101)", "tree")
def lookup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = d.tree(spark, sf_dir)
    name = files.where("parent_id = 101").agg(F.max("name")).first()[0]
    return scans.by_name(files, 101, name).select("id", "parent_id", "name")


@query("SELECT id, barcode, age FROM tape_all ORDER BY age DESC, id LIMIT 7 OFFSET 3", "tape")
def tape_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    tapes = d.tapes(spark, sf_dir, live_only=False).withColumn("create_time", F.timestamp_seconds("age"))
    return scans.list_tapes(tapes, limit=7, offset=3).select("id", "barcode", "age")


@query("SELECT id, status, create_time_ns FROM job WHERE status < 128 ORDER BY create_time_ns DESC, id LIMIT 20 OFFSET 5", "job")
def job_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.list_jobs(d.jobs(spark, sf_dir), offset=5).select("id", "status", "create_time_ns")


@query("SELECT id, status, update_time_ns FROM job WHERE update_time_ns > 800000000000000000 ORDER BY update_time_ns, id LIMIT 50", "job")
def job_recent_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.recent_jobs(d.jobs(spark, sf_dir), after_ns=800_000_000_000_000_000, limit=50).select("id", "status", "update_time_ns")


@query("SELECT id, priority, create_time_ns FROM job WHERE status = 2 ORDER BY priority DESC, create_time_ns, id LIMIT 1", "job")
def next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.next_job(d.jobs(spark, sf_dir)).select("id", "priority", "create_time_ns")


@query(
    """
WITH change AS (SELECT id, CASE WHEN status = 3 THEN 4 ELSE status END AS status, update_time_ns + 5 AS update_time_ns FROM job WHERE id % 6 = 0
                UNION ALL SELECT id + 100000000, status, update_time_ns FROM job WHERE id % 60 = 0),
every AS (SELECT id, status, update_time_ns FROM job WHERE id % 5 <> 0 UNION ALL SELECT * FROM change)
SELECT id, arg_max(status, update_time_ns) AS status, max(update_time_ns) AS update_time_ns FROM every GROUP BY id""",
    "job",
)
def job_feed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = d.jobs(spark, sf_dir).select("id", "status", "update_time_ns")
    done = F.when(F.col("status") == 3, 4).otherwise(F.col("status")).alias("status")
    changes = jobs.where("id % 6 = 0").select("id", done, (F.col("update_time_ns") + 5).alias("update_time_ns")).unionByName(jobs.where("id % 60 = 0").withColumn("id", F.col("id") + 100_000_000))
    return scans.merge_feed(jobs.where("id % 5 <> 0"), changes)


@query("SELECT max(update_time_ns) AS cursor FROM job WHERE status < 128", "job")
def job_feed_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.feed_cursor(d.jobs(spark, sf_dir).where("status < 128"))


@query("SELECT id, name FROM tree WHERE contains(name, '9.tar') ORDER BY name, id LIMIT 100", "tree")
def search_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.search_name(d.tree(spark, sf_dir), "9.tar").select("id", "name")


@query("SELECT id, name, CASE WHEN mode < 2147483648 THEN regexp_extract(name, '(\\.[^.]*)$', 1) ELSE '' END AS ext, starts_with(name, '.') AS is_hidden, mode >= 2147483648 AS is_dir, CASE WHEN mode < 2147483648 THEN size END AS size, CASE WHEN mode >= 2147483648 THEN '777' ELSE '644' END AS permission, epoch(mod_time)::BIGINT AS mod_s FROM tree", "tree")
def browser_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = d.tree(spark, sf_dir)
    view = scans.file_view(files).drop("parent_id")
    return view.join(scans.wire_times(files.select("id", F.col("mod_time").alias("mod_s")), seconds=["mod_s"]), "id")


@query("SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size, coalesce(bool_or(size IS NULL), false) AS has_unknown FROM (SELECT CASE WHEN mode < 2147483648 THEN size END AS size FROM tree)", "tree")
def selection_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.selection_size(scans.file_view(d.tree(spark, sf_dir)))


@query("SELECT p.id, p.name, q.id AS position_id, q.barcode FROM part_file p LEFT JOIN (SELECT position.id, file_id, barcode FROM position JOIN tape ON tape_id = tape.id) q ON q.file_id = p.id", "part_file position tape")
def file_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.file_detail(d.part_files(spark, sf_dir), d.positions(spark, sf_dir), d.tapes(spark, sf_dir)).select("id", "name", "position_id", "barcode")


# Trim and linking


@query("SELECT id, tape_id FROM position WHERE tape_id NOT IN (SELECT id FROM tape)", "position tape")
def trim_orphan_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.orphan_positions(d.positions(spark, sf_dir), d.tapes(spark, sf_dir)).select("id", "tape_id")


@query("SELECT id, name FROM part_file WHERE mode < 2147483648 AND id NOT IN (SELECT file_id FROM position)", "part_file position")
def trim_files_without_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.files_without_position(d.part_files(spark, sf_dir), d.positions(spark, sf_dir)).select("id", "name")


_WIDE = "position_w AS (SELECT id, file_id, tape_id, split_part(path, '/', 1) AS path, write_time, size FROM position)"


def _wide_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with short paths, so that places repeat."""
    return d.positions(spark, sf_dir).withColumn("path", F.substring_index("path", "/", 1))


@query(f"""
WITH {_WIDE},
r AS (SELECT w.id, row_number() OVER (PARTITION BY file_id, tape_id, path ORDER BY write_time DESC, w.id) AS n FROM position_w w JOIN part_file f ON f.id = file_id WHERE f.mode < 2147483648)
SELECT id FROM r WHERE n > 1""", "position part_file")
def position_dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.superseded_positions(_wide_positions(spark, sf_dir), d.part_files(spark, sf_dir)).select("id")


@query(f"""
WITH {_WIDE},
live_p AS (SELECT * FROM position_w WHERE tape_id IN (SELECT id FROM tape)),
r AS (SELECT w.id, row_number() OVER (PARTITION BY file_id, tape_id, path ORDER BY write_time DESC, w.id) AS n FROM live_p w JOIN part_file f ON f.id = file_id WHERE f.mode < 2147483648),
left_p AS (SELECT * FROM live_p WHERE id NOT IN (SELECT id FROM r WHERE n > 1)),
left_f AS (SELECT * FROM part_file WHERE mode >= 2147483648 OR id IN (SELECT file_id FROM left_p))
SELECT 'position' AS kind, id FROM left_p UNION ALL SELECT 'file', id FROM left_f""", "position part_file tape")
def trim_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, positions = trim.trim(d.part_files(spark, sf_dir), _wide_positions(spark, sf_dir), d.tapes(spark, sf_dir))
    return positions.select(F.lit("position").alias("kind"), "id").unionByName(files.select(F.lit("file").alias("kind"), "id"))


@query("SELECT p.doc_id + 1 AS id, min(f.doc_id) + 1 AS file_id FROM content p JOIN content f ON p.signature = f.signature WHERE p.doc_id % 2 = 1 AND f.doc_id % 2 = 0 GROUP BY p.doc_id", "content")
def signature_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.linked_positions(d.content_positions(spark, sf_dir), d.content_files(spark, sf_dir)).select("id", "file_id")


@query("SELECT doc_id + 1 AS id, 'Unforged/' || barcode || '/d/' || doc_id % 5 || '/doc' || doc_id AS target FROM content JOIN tape ON tape.id = doc_id % 10 + 1 WHERE doc_id % 2 = 1 AND signature NOT IN (SELECT signature FROM content WHERE doc_id % 2 = 0)", "content tape")
def signature_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.unmatched_positions(d.content_positions(spark, sf_dir), d.content_files(spark, sf_dir), d.tapes(spark, sf_dir)).select("id", "target")


@query("""
WITH open AS (SELECT doc_id + 1 AS id, signature, 'doc' || doc_id AS name FROM content JOIN tape ON tape.id = doc_id % 10 + 1 WHERE doc_id % 2 = 1 AND signature NOT IN (SELECT signature FROM content WHERE doc_id % 2 = 0)),
own AS (SELECT signature, arg_min(name, id) AS name FROM open GROUP BY signature),
linked AS (SELECT p.doc_id + 1 AS id, 'doc' || min(f.doc_id) AS name FROM content p JOIN content f ON p.signature = f.signature WHERE p.doc_id % 2 = 1 AND f.doc_id % 2 = 0 GROUP BY p.doc_id)
SELECT open.id, own.name FROM open JOIN own USING (signature) UNION ALL SELECT id, name FROM linked""", "content tape")
def link_new_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of the file that each position hangs on after linking."""
    files, positions, _ = trim.link_new_positions(d.content_files(spark, sf_dir), d.content_positions(spark, sf_dir), d.tapes(spark, sf_dir))
    return positions.where("file_id <> 0").select("id", "file_id").join(files.select(F.col("id").alias("file_id"), "name"), "file_id").select("id", "name")


# The tree

_CLOSURE = "up AS (SELECT id AS leaf, parent_id AS above, size, mode FROM tree UNION ALL SELECT leaf, tree.parent_id, up.size, up.mode FROM up JOIN tree ON tree.id = above WHERE above <> 0)"


@query(f"""
WITH {_CLOSURE},
s AS (SELECT above, CAST(sum(size) AS BIGINT) AS total_size, count(*) FILTER (WHERE mode < 2147483648) AS total_files FROM up GROUP BY above)
SELECT id, coalesce(total_size, 0) AS total_size, coalesce(total_files, 0) AS total_files FROM (SELECT id FROM tree WHERE mode >= 2147483648 UNION ALL SELECT 0) LEFT JOIN s ON above = id""", "tree", recursive=True)
def dir_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.directory_usage(d.tree(spark, sf_dir))


@query(f"""
WITH {_CLOSURE},
s AS (SELECT above, CAST(sum(size) AS BIGINT) AS below FROM up GROUP BY above)
SELECT id, name, size + coalesce(below, 0) AS size FROM tree LEFT JOIN s ON above = id WHERE parent_id = 2""", "tree", recursive=True)
def children_with_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.usage_below(d.tree(spark, sf_dir), 2).select("id", "name", "size")


@query("""
WITH up AS (SELECT id AS start, 0 AS steps, id, parent_id, name FROM tree WHERE mode < 2147483648
            UNION ALL SELECT start, steps + 1, tree.id, tree.parent_id, tree.name FROM up JOIN tree ON tree.id = up.parent_id)
SELECT start, CAST(steps AS INTEGER) AS steps, id, name FROM up""", "tree", recursive=True)
def file_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = d.tree(spark, sf_dir)
    return tree.ancestors(files, files.where(~is_dir(F.col("mode")))).select("start", "steps", "id", "name")


_PATHS = "full_path AS (SELECT id, name AS path, 1 AS depth, mode, size FROM tree WHERE parent_id = 0 UNION ALL SELECT tree.id, path || '/' || name, depth + 1, tree.mode, tree.size FROM full_path JOIN tree ON tree.parent_id = full_path.id)"


@query(f"""
WITH {_PATHS}
SELECT id, path AS full_path, CAST(depth AS INTEGER) AS depth FROM full_path""", "tree", recursive=True)
def materialized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.full_paths(d.tree(spark, sf_dir))


@query(f"""
WITH {_PATHS},
w AS (SELECT path, id FROM full_path WHERE depth = 2)
SELECT '//' || path || '/.' AS path, id FROM w UNION ALL SELECT path || '/none', NULL FROM w UNION ALL SELECT 'a' || chr(92) || 'b', NULL""", "tree", recursive=True)
def resolve_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = d.tree(spark, sf_dir)
    w = tree.full_paths(files).where("depth = 2")
    wanted = w.select(F.concat(F.lit("//"), "full_path", F.lit("/.")).alias("path")).unionByName(w.select(F.concat("full_path", F.lit("/none")).alias("path"))).unionByName(spark.range(1).select(F.lit("a\\b").alias("path")))
    return tree.resolve(files, wanted)


@query("SELECT id AS root, EXISTS (SELECT 1 FROM tree t WHERE t.parent_id = tree.id) AS holds_files FROM tree WHERE id BETWEEN 1000000 AND 999999999", "tree")
def purge_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = d.tree(spark, sf_dir)
    return tree.holds_files(files, files.where("id between 1000000 and 999999999").select(F.col("id").alias("root")))


# Restore planning


@query(f"""
WITH {_PATHS},
chosen AS (SELECT unnest([3, 105, 110, 1000003, 1000000001]) AS id),
top AS (SELECT c.id, p.path FROM chosen c JOIN full_path p USING (id) WHERE NOT EXISTS (
          SELECT 1 FROM chosen o JOIN full_path q ON q.id = o.id WHERE o.id <> c.id AND starts_with(p.path, q.path || '/')))
SELECT f.id AS file_id, f.size, substr(f.path, strlen(top.path) - strlen(regexp_extract(top.path, '[^/]*$')) + 1) AS target_path
FROM full_path f JOIN top ON f.path = top.path OR starts_with(f.path, top.path || '/') WHERE f.mode < 2147483648""", "tree", recursive=True)
def restore_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.createDataFrame([(i,) for i in (3, 105, 110, 1000003, 1000000001)], "id long")
    return restore.expand(d.tree(spark, sf_dir), chosen).select("file_id", "size", "target_path")


_PAIRS = "pair AS (SELECT DISTINCT tape_id, file_id FROM position WHERE file_id IN (SELECT id FROM part_file) AND tape_id IN (SELECT id FROM tape))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = d.part_files(spark, sf_dir).select(F.col("id").alias("file_id"))
    return restore.candidates(wanted, d.positions(spark, sf_dir), d.tapes(spark, sf_dir))


@query(f"""
WITH {_PAIRS}
SELECT tape_id, count(*) AS files FROM pair GROUP BY tape_id""", "position part_file tape")
def restore_cover_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.cover_counts(_pairs(spark, sf_dir))


@query(f"""
WITH {_PAIRS},
t0 AS (SELECT tape_id FROM pair GROUP BY tape_id ORDER BY count(*) DESC, tape_id LIMIT 1),
s0 AS (SELECT * FROM pair WHERE tape_id = (SELECT * FROM t0)),
p1 AS (SELECT * FROM pair WHERE file_id NOT IN (SELECT file_id FROM s0)),
t1 AS (SELECT tape_id FROM p1 GROUP BY tape_id ORDER BY count(*) DESC, tape_id LIMIT 1),
s1 AS (SELECT * FROM p1 WHERE tape_id = (SELECT * FROM t1)),
p2 AS (SELECT * FROM p1 WHERE file_id NOT IN (SELECT file_id FROM s1)),
t2 AS (SELECT tape_id FROM p2 GROUP BY tape_id ORDER BY count(*) DESC, tape_id LIMIT 1),
s2 AS (SELECT * FROM p2 WHERE tape_id = (SELECT * FROM t2))
SELECT 0 AS step, * FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2""", "position part_file tape")
def restore_greedy_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the three tapes to load first, with the files to read from each; ``restore_greedy`` is the whole cover."""
    return restore.greedy_cover(_pairs(spark, sf_dir), max_steps=3)


@query()
def restore_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cover, until no file is left; its first three steps are ``restore_greedy_3``."""
    return restore.greedy_cover(_pairs(spark, sf_dir))


@query()
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of all part files: the greedy steps depend on each other without end, which SQL can't express."""
    files = d.part_files(spark, sf_dir).withColumn("hash", F.lit(None).cast("binary"))
    return restore.plan(files, d.positions(spark, sf_dir), d.tapes(spark, sf_dir), files.select("id")).drop("hash")


# Jobs


@query("""
WITH s AS (SELECT user_id AS job_id, event_id AS seq, [1, 2, 1, 2, 255][event_id % 5 + 1] AS step FROM events),
f AS (SELECT *, lag(step, 1, 0) OVER (PARTITION BY job_id ORDER BY seq) AS from_step FROM s)
SELECT job_id, seq, from_step, step, (from_step, step) IN ((0, 1), (2, 1), (1, 2), (2, 255)) AS legal, CASE step WHEN 255 THEN 4 ELSE 3 END AS status FROM f""")
def job_state_transition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.check_transitions(d.steps_log(spark, sf_dir))


_CARD = """
c AS (SELECT job_id AS id, count(*) AS total_files, sum(size) AS total_bytes, count(*) FILTER (WHERE status = 4) AS submited_files, coalesce(sum(size) FILTER (WHERE status = 4), 0) AS submited_bytes,
        count(*) FILTER (WHERE status IN (3, 4)) AS success_files, coalesce(sum(size) FILTER (WHERE status IN (3, 4)), 0) AS success_bytes FROM source GROUP BY job_id),
k AS (SELECT c.*, live.speed, submited_bytes + coalesce(copied_bytes, 0) AS copied, submited_files + coalesce(copied_files, 0) AS copied_files FROM c LEFT JOIN live USING (id))"""
_CARD_COLUMNS = "id, CAST(total_files AS INTEGER) AS total_files, CAST(total_bytes AS BIGINT) AS total_bytes, CAST(submited_files AS INTEGER) AS submited_files, CAST(submited_bytes AS BIGINT) AS submited_bytes, CAST(copied_files AS BIGINT) AS copied_files, CAST(copied AS BIGINT) AS copied_bytes, CASE WHEN total_bytes > 0 THEN CAST(copied AS DOUBLE) * 100.0::DOUBLE / CAST(total_bytes AS DOUBLE) ELSE 100.0::DOUBLE END AS progress, CASE WHEN speed > 0 THEN CAST(ceil((total_bytes - copied) / speed::DOUBLE) AS BIGINT) END AS eta_s"


@query(f"WITH {_CARD.strip()}\nSELECT {_CARD_COLUMNS} FROM k", "position source job live")
def archive_progress_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = j.archive_card(d.archive_states(spark, sf_dir), d.live(spark, sf_dir))
    return card.select("id", "total_files", "total_bytes", "submited_files", "submited_bytes", "copied_files", "copied_bytes", "progress", "eta_s")


@query(f"WITH {_CARD.strip()}\nSELECT {_CARD_COLUMNS}, CAST(success_files AS INTEGER) AS success_files, CAST(success_bytes AS BIGINT) AS success_bytes FROM k", "position source job live")
def restore_progress_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = j.restore_card(d.restore_states(spark, sf_dir), d.live(spark, sf_dir))
    return card.select("id", "total_files", "total_bytes", "submited_files", "submited_bytes", "copied_files", "copied_bytes", "progress", "eta_s", "success_files", "success_bytes")


@query("SELECT count(*) FILTER (WHERE status <> 4) AS remaining FROM source", "position source")
def archive_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.remaining(d.archive_states(spark, sf_dir).select(F.inline("sources")))


@query("""
WITH o AS (SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY id) - 1 AS i, status FROM source),
r AS (SELECT job_id, i, CASE WHEN i >= 2 THEN 1 ELSE status END AS status FROM o)
SELECT job_id AS id, count(*) FILTER (WHERE status = 1) AS pending, CAST(min(i) FILTER (WHERE status <> 4) AS INTEGER) AS first_unfinished FROM r GROUP BY job_id""", "position source")
def job_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = j.rollback(d.archive_states(spark, sf_dir), F.lit(2))
    pending = back.select("id", F.size(F.filter("sources", lambda s: s["status"] == 1)).cast("long").alias("pending"))
    return pending.join(j.first_unfinished(back), "id")


@query("SELECT job.id, job.status, CASE WHEN job.status = 3 THEN copied_bytes END AS copied_bytes, CASE WHEN job.status = 3 THEN speed END AS speed FROM job LEFT JOIN live ON live.id = job.id", "job live")
def job_list_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.job_list_with_live(d.jobs(spark, sf_dir), d.live(spark, sf_dir)).select("id", "status", "copied_bytes", "speed")


_EVENT = "e AS (SELECT id, event_id AS seq, ['pending', 'preparing', 'copying', 'finished', 'noise'][event_id % 5 + 1] AS event, event_id % 3 AS successes FROM events JOIN part_file ON part_file.id = user_id * 2 + 1)"


def _copy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("pending", "preparing", "copying", "finished", "noise")])
    return d.load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") * 2 + 1).alias("path"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("event"), (F.col("event_id") % 3).alias("successes"))


@query(f"""
WITH {_EVENT},
l AS (SELECT id, arg_max(event, seq) AS event, arg_max(successes, seq) AS successes FROM e WHERE event <> 'noise' GROUP BY id)
SELECT part_file.id AS path, CASE event WHEN 'pending' THEN 1 WHEN 'preparing' THEN 1 WHEN 'copying' THEN 2 WHEN 'finished' THEN CASE WHEN successes > 0 THEN 3 ELSE 255 END ELSE 0 END AS status FROM part_file LEFT JOIN l USING (id)""", "part_file")
def archive_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = d.part_files(spark, sf_dir).select(F.col("id").alias("path"), F.lit(COPY_STATUS["DRAFT"]).alias("status"))
    return j.archive_status(sources, _copy_events(spark, sf_dir))


_RESTORED = "v AS (SELECT doc_id, doc_id % 7 AS tape_id, doc_id % 11 = 0 AS bad_hash, doc_id % 13 = 0 AS bad_size, doc_id % 17 = 0 AS failed FROM content), w AS (SELECT doc_id, tape_id, CASE WHEN failed OR bad_hash OR bad_size THEN 255 ELSE 3 END AS status FROM v)"


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.contents(spark, sf_dir)
    files = c.select("doc_id", (F.col("doc_id") % 7).alias("tape_id"), F.lit("T00001").alias("barcode"), F.col("doc_id").cast("string").alias("tape_path"), "hash", "size", F.lit(1).alias("status"))
    sha = F.when(F.col("doc_id") % 11 == 0, F.lit("00")).otherwise(values.hex_lower(F.col("hash")))
    events = c.select(F.lit(1).alias("seq"), F.lit("T00001").alias("barcode"), F.col("doc_id").cast("string").alias("tape_path"), F.lit("finished").alias("event"), (F.col("doc_id") % 17 == 0).cast("int").alias("failures"), sha.alias("sha256"), (F.col("size") + (F.col("doc_id") % 13 == 0).cast("int")).alias("got_size"))
    return j.restore_status(files, events)


@query(f"WITH {_RESTORED}\nSELECT doc_id, status FROM w", "content")
def restore_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored(spark, sf_dir).select("doc_id", "status")


@query(f"WITH {_RESTORED}\nSELECT t AS tape_id, CASE WHEN coalesce(bool_and(status = 3), true) THEN 4 ELSE 255 END AS status FROM (SELECT unnest(range(0, 9)) AS t) LEFT JOIN w ON tape_id = t GROUP BY t", "content")
def restore_tape_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.tape_status(spark.range(9).select(F.col("id").alias("tape_id")), j.submit_staged(_restored(spark, sf_dir)))


@query("SELECT coalesce(bool_and(status IN (4, 255)), true) AS finished FROM job", "job")
def job_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("status").isin(4, 255), COPY_STATUS["SUBMITED"]).otherwise(COPY_STATUS["FAILED"])
    return j.job_finished(d.jobs(spark, sf_dir).select(status.alias("status")))


@query("SELECT path, count(*) AS n FROM (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 3) AS path FROM position) GROUP BY path HAVING count(*) > 1", "position")
def duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("path", "/")
    s = d.positions(spark, sf_dir).select(F.array(parts[0], parts[2]).alias("path"))
    return j.duplicate_sources(s).select(F.array_join("path", "/").alias("path"), "n")


@query("SELECT 'doc' || doc_id AS path, size, hash FROM content WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0", "content")
def report_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.contents(spark, sf_dir)
    sha = F.when(F.col("doc_id") % 5 == 0, F.lit("zz")).otherwise(values.hex_lower(F.col("hash")))
    report = c.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), "size", F.lit(0o644).cast("long").alias("mode"), F.lit(None).cast("timestamp").alias("mod_time"), F.lit(None).cast("timestamp").alias("write_time"), sha.alias("sha256"), (F.col("doc_id") % 3).alias("successes"))
    return j.report_files(report).select("path", "size", values.hex_lower(F.col("hash")).alias("hash"))


@query("SELECT id, CASE status WHEN 2 THEN 'PENDING' WHEN 3 THEN 'PROCESSING' WHEN 4 THEN 'COMPLETED' ELSE 'DELETED' END AS status_name, CAST(create_time_ns / 1000000000 AS BIGINT) AS created_s FROM job", "job")
def job_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.jobs(spark, sf_dir).select("id", enum_name(F.col("status"), JOB_STATUS).alias("status_name"), F.floor(F.col("create_time_ns") / 1_000_000_000).alias("created_s"))


@query("""
WITH w AS (SELECT job_id, t, bytes, first_value(bytes) OVER f AS b0, first_value(t) OVER f AS t0, count(*) OVER f AS n FROM progress WINDOW f AS (PARTITION BY job_id ORDER BY t, bytes ROWS 29 PRECEDING))
SELECT job_id, t, bytes, CASE WHEN n = 1 THEN 0 WHEN t <> t0 THEN CAST(((bytes - b0)::HUGEINT * 1000000000) // ((epoch_us(t) - epoch_us(t0)) * 1000) AS BIGINT) END AS speed FROM w""", "progress")
def progress_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.copy_speed(d.progress_events(spark, sf_dir))


# Mutations


@query("SELECT id, barcode FROM tape_all WHERE id NOT IN (2, 3, 4)", "tape")
def delete_tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.delete_tapes(d.tapes(spark, sf_dir, live_only=False), [2, 3, 4]).select("id", "barcode")


@query("SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM position WHERE id % 10 <> 3", "position")
def delete_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.positions(spark, sf_dir)
    return mutations.delete_positions(p, p.where("id % 10 = 3").select("id")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT id, barcode, CASE WHEN id % 4 = 0 THEN 'new' ELSE name END AS name FROM tape_all UNION ALL SELECT id + 1000000, barcode || 'x', 'new' FROM tape_all WHERE id % 40 = 0", "tape")
def upsert_tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.tapes(spark, sf_dir, live_only=False).select("id", "barcode", "name")
    new = t.where("id % 4 = 0").withColumn("name", F.lit("new")).unionByName(t.where("id % 40 = 0").select((F.col("id") + 1_000_000).alias("id"), F.concat("barcode", F.lit("x")).alias("barcode"), F.lit("new").alias("name")))
    return mutations.upsert(t, new)


@query("SELECT tape_id, CAST(sum(size) AS BIGINT) AS writen_bytes, count(*) AS files FROM position GROUP BY tape_id", "position")
def tape_written_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.positions(spark, sf_dir).groupBy("tape_id").agg(F.sum("size").alias("writen_bytes"), F.count("*").alias("files"))


@query("""
WITH f AS (SELECT path, size FROM position WHERE tape_id = 2)
SELECT 0 AS file_id, 'NEW001' AS barcode, path, size, CAST((SELECT sum(size) FROM f) AS BIGINT) AS writen_bytes, CAST((SELECT sum(size) FROM f) AS BIGINT) AS capacity_bytes FROM f""", "position")
def create_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.positions(spark, sf_dir)
    tapes = d.tapes(spark, sf_dir).select("id", "barcode", "capacity_bytes").withColumn("writen_bytes", F.lit(0).cast("long"))
    new = spark.range(1).select(F.lit(10_000_000).cast("long").alias("id"), F.lit("NEW001").alias("barcode"), F.lit(0).cast("long").alias("capacity_bytes"), F.lit(0).cast("long").alias("writen_bytes"))
    tapes, p = mutations.create_tape(tapes, p, new, p.where("tape_id = 2").select("path", "size", "mode", "mod_time", "write_time", "hash"))
    placed = p.where("tape_id = 10000000").join(tapes, p["tape_id"] == tapes["id"])
    return placed.select(F.col("file_id").cast("int").alias("file_id"), "barcode", "path", "size", "writen_bytes", "capacity_bytes")


@query(f"""
WITH {_PATHS},
m AS (SELECT CASE WHEN path = 'ASIA' OR starts_with(path, 'ASIA/') THEN 'EUROPE/old' || substr(path, 5) ELSE path END AS path FROM full_path)
SELECT path FROM m""", "tree", recursive=True)
def move_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASIA moves into EUROPE under another name."""
    files = d.tree(spark, sf_dir)
    ids = {r["name"]: r["id"] for r in files.where("parent_id = 0").collect()}
    return tree.full_paths(mutations.move(files, ids["ASIA"], ids["EUROPE"], "old")).select(F.col("full_path").alias("path"))


@query(f"""
WITH {_PATHS},
m AS (SELECT DISTINCT CASE WHEN depth > 1 AND starts_with(path, 'ASIA/') THEN 'EUROPE' || substr(path, 5) ELSE path END AS path FROM full_path WHERE path <> 'ASIA')
SELECT path FROM m""", "tree", recursive=True)
def move_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASIA is moved onto EUROPE, so both become one directory."""
    files = d.tree(spark, sf_dir)
    ids = {r["name"]: r["id"] for r in files.where("parent_id = 0").collect()}
    return tree.full_paths(mutations.move(files, ids["ASIA"], 0, "EUROPE")).select(F.col("full_path").alias("path"))


@query(f"""
WITH {_PATHS},
m AS (SELECT CASE WHEN path = 'ASIA' OR starts_with(path, 'ASIA/') THEN '.Trash/2024-05-06T07:08:09Z/' || path ELSE path END AS path FROM full_path)
SELECT path FROM m UNION ALL SELECT '.Trash' UNION ALL SELECT '.Trash/2024-05-06T07:08:09Z'""", "tree", recursive=True)
def delete_to_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = d.tree(spark, sf_dir)
    asia = files.where("parent_id = 0 and name = 'ASIA'").first()["id"]
    return tree.full_paths(mutations.delete(files, [asia, asia], F.to_timestamp(F.lit("2024-05-06 07:08:09")))).select(F.col("full_path").alias("path"))


@query(f"""
WITH {_PATHS}
SELECT path FROM full_path UNION ALL SELECT unnest(['ASIA/new', 'ASIA/new/deep', 'fresh'])""", "tree", recursive=True)
def mkdir_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("/ASIA/new/deep/",), ("ASIA",), ("fresh",)], "path string")
    files, _ = mutations.make_directories(d.tree(spark, sf_dir), wanted)
    return tree.full_paths(files).select(F.col("full_path").alias("path"))


@query(f"""
WITH {_PATHS},
m AS (SELECT CASE WHEN path = 'ASIA' OR starts_with(path, 'ASIA/') THEN 'x/y' || substr(path, 5) ELSE path END AS path FROM full_path)
SELECT path FROM m UNION ALL SELECT 'x'""", "tree", recursive=True)
def edit_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name of two segments makes a directory and moves there."""
    files = d.tree(spark, sf_dir)
    asia = files.where("parent_id = 0 and name = 'ASIA'").first()["id"]
    return tree.full_paths(mutations.edit(files, asia, name=" x\\y ")).select(F.col("full_path").alias("path"))


@query("SELECT id, CASE WHEN id IN (2, 5) THEN 255 ELSE status END AS status, CASE WHEN id IN (2, 5) THEN 77 ELSE update_time_ns END AS update_time_ns FROM job", "job")
def delete_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.delete_jobs(d.jobs(spark, sf_dir), [2, 5], F.lit(77).cast("long")).select("id", "status", "update_time_ns")


@query("SELECT 'tape' AS kind, id, barcode AS field FROM tape_all UNION ALL SELECT 'file', id, name FROM tree UNION ALL SELECT 'position', id, path FROM position", "tape tree position")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    tapes = d.tapes(spark, sf_dir, live_only=False).select("id", "barcode", "name", F.lit("").alias("encryption"), none.cast("timestamp").alias("create_time"), none.cast("timestamp").alias("destroy_time"), "capacity_bytes", F.lit(0).cast("long").alias("writen_bytes"))
    rows = catalog_json.export_rows({"tape": tapes, "file": d.tree(spark, sf_dir), "position": d.positions(spark, sf_dir)}, ["Tape", "file", "other", "POSITION"])
    return rows.select("kind", "id", F.coalesce(*[F.get_json_object("json", f"$.{x}") for x in ("barcode", "name", "path")]).alias("field"))


@query("SELECT 'tape' AS kind, id, barcode AS text, capacity_bytes AS amount FROM tape_all UNION ALL SELECT 'file', id, name, size FROM tree UNION ALL SELECT 'position', id, path, size FROM position", "tape tree position")
def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the catalog, written as JSON and read back."""
    none = F.lit(None)
    tapes = d.tapes(spark, sf_dir, live_only=False).select("id", "barcode", "name", F.lit("").alias("encryption"), none.cast("timestamp").alias("create_time"), none.cast("timestamp").alias("destroy_time"), "capacity_bytes", F.lit(0).cast("long").alias("writen_bytes"))
    back = catalog_json.import_rows(catalog_json.export_rows({"tape": tapes, "file": d.tree(spark, sf_dir), "position": d.positions(spark, sf_dir)}))
    part = lambda kind, text, amount: back[kind].select(F.lit(kind).alias("kind"), "id", F.col(text).alias("text"), F.col(amount).alias("amount"))
    return part("tape", "barcode", "capacity_bytes").unionByName(part("file", "name", "size")).unionByName(part("position", "path", "size"))


# Functions


@query("""
WITH s AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM page_path),
c AS (SELECT page_id, path, CASE WHEN page_id % 3 = 0 THEN list_concat(parts[1:len(parts) - 3], parts[len(parts):]) ELSE parts END AS parts FROM s)
SELECT page_id, '/' || array_to_string(parts, '/') AS cleaned, split_part('/' || array_to_string(parts, '/'), '/', -1) AS base, CASE WHEN page_id % 3 = 0 THEN '.gz' ELSE regexp_extract(split_part('/' || array_to_string(parts, '/'), '/', -1), '(\\.[^.]*)$', 1) END AS ext, CAST(len(list_filter(string_split(path, '/'), lambda x: trim(x) <> '')) AS INTEGER) AS n_segments FROM c""", "page_path")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.url_paths(spark, sf_dir).withColumn("cleaned", paths.clean(F.col("path")))
    base = paths.basename(F.col("cleaned"))
    return p.select("page_id", "cleaned", base.alias("base"), paths.extension(base).alias("ext"), F.size(paths.segments(F.col("path"))).alias("n_segments"))


@query("SELECT path, row_number() OVER (ORDER BY replace(path, '/', chr(0))) AS n FROM (SELECT DISTINCT path FROM page_path)", "page_path")
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each path in media order; the ranks come from range partitions, not from one task."""
    p = d.url_paths(spark, sf_dir).select("path").distinct().withColumn("key", paths.order_key(F.col("path")))
    return trim.numbered(p, 0, "key").select("path", F.col("id").alias("n"))


@query("""
WITH s AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM page_path),
i AS (SELECT page_id, parts, unnest(range(0, len(parts) + 1)) AS i FROM s)
SELECT page_id, CAST(i AS INTEGER) AS i, CASE WHEN i = 0 THEN 'Root' ELSE parts[i] END AS name, CASE WHEN i = 0 THEN './' ELSE array_to_string(parts[1:i], '/') || '/' END AS path FROM i""", "page_path")
def source_crumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.url_paths(spark, sf_dir).select("page_id", F.posexplode(filesystem.crumbs(F.col("path"))).alias("i", "c"))
    return p.select("page_id", "i", "c.name", "c.path")


@query("SELECT doc_id, lower(signature) AS signature, CAST(size AS BIGINT) AS size_read FROM content", "content")
def content_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.contents(spark, sf_dir)
    return c.select("doc_id", values.hex_lower(F.col("signature")).alias("signature"), values.unsigned(F.substring("signature", 34, 8)).cast("long").alias("size_read"))


@query("""
WITH g AS (SELECT unnest([64, 66, 68, 70, 88, 90, 92, 93, 94, 96]) AS density, unnest(['LTO-1', 'LTO-2', 'LTO-3', 'LTO-4', 'LTO-5', 'LTO-6', 'LTO-7', 'LTO-M8', 'LTO-8', 'LTO-9']) AS generation, unnest([100, 200, 400, 800, 1500, 2500, 6000, 9000, 12000, 18000]) AS native_gb),
t AS (SELECT id, CAST([64, 66, 68, 70, 88, 90, 92, 93, 94, 96, 1][id % 11 + 1] AS INTEGER) AS density, capacity_bytes AS m, id * 7 AS r FROM tape_all)
SELECT id, t.density, generation, native_gb, CASE WHEN m > 0 THEN CAST(CAST(r * 100 // m AS BIGINT) AS VARCHAR) ELSE '?' END AS free_percent FROM t LEFT JOIN g ON g.density = t.density""", "tape")
def lto_density_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in (64, 66, 68, 70, 88, 90, 92, 93, 94, 96, 1)])
    t = d.tapes(spark, sf_dir, live_only=False).select("id", F.element_at(codes, (F.col("id") % 11 + 1).cast("int")).alias("density"), F.col("capacity_bytes").alias("m"), (F.col("id") * 7).alias("r"))
    return cartridge.with_generation(t, "density").select("id", "density", "generation", "native_gb", cartridge.free_percent(F.col("r"), F.col("m")).alias("free_percent"))


# Order, single rows and display: operators whose order or text is their result


def _placed(page: DataFrame) -> DataFrame:
    """A page's rows with their place, from 0; a page has few rows."""
    return page.coalesce(1).withColumn("n", F.monotonically_increasing_id())


@query("SELECT id, barcode, row_number() OVER (ORDER BY age DESC, id) - 1 AS n FROM tape_all QUALIFY n < 20", "tape")
def tape_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tapes = d.tapes(spark, sf_dir, live_only=False).withColumn("create_time", F.timestamp_seconds("age"))
    return _placed(scans.list_tapes(tapes, limit=20)).select("id", "barcode", "n")


@query("SELECT id, row_number() OVER (ORDER BY create_time_ns DESC, id) - 1 AS n FROM job WHERE status = 3 QUALIFY n < 20", "job")
def job_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(scans.list_jobs(d.jobs(spark, sf_dir), status=JOB_STATUS["PROCESSING"])).select("id", "n")


@query("SELECT id, row_number() OVER (ORDER BY update_time_ns, id) - 1 AS n FROM job WHERE update_time_ns > 700000000000000000 QUALIFY n < 20", "job")
def job_feed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(scans.recent_jobs(d.jobs(spark, sf_dir), after_ns=700_000_000_000_000_000)).select("id", "n")


@query("SELECT id, name, row_number() OVER (ORDER BY name) - 1 AS n FROM tree WHERE parent_id = 3", "tree")
def children_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One directory's children, in order of name."""
    return _placed(scans.children(d.tree(spark, sf_dir), 3)).select("id", "name", "n")


@query("SELECT id, status FROM job WHERE id IN (1, 2, 7, 33)", "job")
def multi_get_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.multi_get(d.jobs(spark, sf_dir), [33, 1, 2, 7, 7, -1]).select("id", "status")


@query("SELECT id, name, parent_id FROM tree WHERE id = 105", "tree")
def get_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.get(d.tree(spark, sf_dir), 105).select("id", "name", "parent_id")


@query("""
WITH p AS (SELECT tape_id, file_id, arg_min(path, id) AS path FROM position WHERE tape_id IN (SELECT id FROM tape) GROUP BY tape_id, file_id)
SELECT tape_id, file_id, CAST(row_number() OVER (PARTITION BY tape_id ORDER BY replace(path, '/', chr(0)), file_id) AS INTEGER) AS seq FROM p""", "position tape")
def restore_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of each tape in the order in which they are read from it."""
    p = d.positions(spark, sf_dir).join(d.tapes(spark, sf_dir).select(F.col("id").alias("tape_id")), "tape_id", "left_semi")
    first = restore.first_positions(p).withColumn("step", F.col("tape_id"))
    return restore.reading_order(first).select("tape_id", "file_id", "seq")


@query("""
WITH s AS (SELECT DISTINCT list_filter(string_split(path, '/'), lambda x: x <> '') AS path FROM page_path)
SELECT '/in/' AS base, array_to_string(path, '/') AS path, row_number() OVER (ORDER BY path) - 1 AS n, 1 AS status FROM s WHERE len(path) > 0""", "page_path")
def archive_plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in order of their segments; the places come from range partitions."""
    s = d.url_paths(spark, sf_dir).select(F.filter(F.split("path", "/"), lambda x: x != "").alias("path")).where(F.size("path") > 0).distinct()
    plan = j.archive_plan(s.withColumn("size", F.lit(1).cast("long")), "/in/")
    return trim.numbered(plan, -1, "path").select("base", F.array_join("path", "/").alias("path"), F.col("id").alias("n"), "status")


@query("SELECT id AS path, 1 AS size FROM part_file WHERE id IN (SELECT user_id * 2 + 1 FROM events WHERE event_id % 3 > 0)", "part_file")
def report_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files that some copy event reports a success of."""
    report = _copy_events(spark, sf_dir).select("path", "successes")
    return j.report_sources(report, d.part_files(spark, sf_dir).select(F.col("id").alias("path"), F.lit(1).alias("size")))


@query("SELECT id, tape_id FROM (SELECT position.id, tape_id, barcode FROM position JOIN tape ON tape_id = tape.id) WHERE barcode = 'T00003'", "position tape")
def plan_by_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = d.positions(spark, sf_dir).join(d.tapes(spark, sf_dir).select(F.col("id").alias("tape_id"), "barcode"), "tape_id")
    return j.by_barcode(plan, "t00003-x").select("id", "tape_id")


@query("SELECT id, CASE WHEN id = 1 THEN 4 ELSE status END AS status, CASE WHEN id = 1 THEN 9 ELSE update_time_ns END AS update_time_ns FROM job", "job")
def edit_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = d.jobs(spark, sf_dir).withColumn("status", F.when(F.col("id") == 1, JOB_STATUS["PENDING"]).otherwise(F.col("status"))).withColumn("state", F.lit(None).cast("struct<step:int>"))
    return mutations.edit_job_state(jobs, 1, JOB_STATUS["COMPLETED"], None, F.lit(9).cast("long")).select("id", "status", "update_time_ns")


@query("SELECT page_id, trim(url) AS trimmed, upper(substr(split_part(url, '/', 3), 1, 6)) AS barcode, CASE WHEN page_id % 2 = 0 THEN upper(substr(CAST(page_id AS VARCHAR) || 'abcdef', 1, 6)) END AS from_json FROM pages")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.load(spark, sf_dir, "pages")
    reply = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"barcode":"'), F.col("page_id").cast("string"), F.lit('abcdefgh"}'))).otherwise("{}")
    return p.select("page_id", paths.trim_space(F.concat(F.lit(" \t\u3000"), "url", F.lit("\u00a0 "))).alias("trimmed"), values.barcode(F.split("url", "/")[2]).alias("barcode"), values.json_barcode(reply).alias("from_json"))


@query(r"""
WITH s AS (SELECT id, size * (1 + id % 5) * CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END AS n FROM tree),
u AS (SELECT id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS k FROM s)
SELECT id, regexp_replace(printf('%.2f', round(n / power(1024, k), 2)), '\.?0+$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][k + 1] AS shown FROM u WHERE n >= 1""", "tree")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 1024).otherwise(1 << 20)
    sizes = d.tree(spark, sf_dir).select("id", (F.col("size") * (1 + F.col("id") % 5) * factor).alias("n"))
    return sizes.where("n >= 1").select("id", values.file_size(F.col("n")).alias("shown"))


@query("""
WITH t AS (SELECT id, barcode, id * 7 AS left_mib, 1000 + id AS max_mib, id * 11 AS written, id * 3 AS read_mib, [64, 66, 68, 88, 1][id % 5 + 1] AS density FROM tape_all),
g AS (SELECT unnest([64, 66, 68, 88]) AS density, unnest(['LTO-1', 'LTO-2', 'LTO-3', 'LTO-5']) AS generation, unnest([83, 83, 83, 190]) AS minutes, unnest([48, 64, 44, 80]) AS passes, unnest([384, 512, 704, 1280]) AS tracks)
SELECT id AS cartridge, generation, CAST(left_mib * 100 // max_mib AS VARCHAR) AS free_percent, CAST(written AS DOUBLE) / max_mib AS fve, CAST(read_mib AS DOUBLE) / max_mib AS read_fve, minutes // 60 || 'h' || minutes % 60 AS fill_time,
       CAST(passes AS INTEGER) AS passes, minutes * 60.0::DOUBLE / passes AS pass_seconds, CAST(tracks AS INTEGER) AS tracks_in_all, CASE id % 3 WHEN 0 THEN 'Data cartridge' WHEN 1 THEN 'Cleaning cartridge (50 cycles max)' ELSE 'WORM (Write-once) cartridge' END AS type_name,
       'MAKER' AS manufacturer, 'HP' AS vendor, 'S' || barcode AS serial
FROM t LEFT JOIN g USING (density)""", "tape")
def cartridge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each tape from attributes as a drive gives them, big-endian or as padded text."""
    t = d.tapes(spark, sf_dir, live_only=False)
    density = F.element_at(F.array(*[F.lit(x) for x in (64, 66, 68, 88, 1)]), (F.col("id") % 5 + 1).cast("int"))
    kind = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 1).otherwise(0x80)
    number = lambda code, value, width=8: F.struct(F.lit(code).alias("command"), values.big_endian(value, width).alias("data"))
    text = lambda code, value: F.struct(F.lit(code).alias("command"), value.cast("binary").alias("data"))
    attributes = F.array(
        number(0x0000, F.col("id") * 7), number(0x0001, F.col("id") + 1000), number(0x0220, F.col("id") * 11), number(0x0221, F.col("id") * 3), number(0x0405, density, 1), number(0x0408, kind, 1), number(0x0409, F.lit(50), 2),
        text(0x0400, F.lit("MAKER   ")), text(0x020A, F.concat(F.lit("HP      S"), "barcode", F.lit("\0 "))))
    raw = t.select(F.col("id").alias("cartridge"), F.inline(attributes))
    report = cartridge.attribute_report(raw)
    return report.select("cartridge", "generation", "free_percent", F.col("fve").cast("double").alias("fve"), F.col("read_fve").cast("double").alias("read_fve"), "fill_time", "passes", "pass_seconds", "tracks_in_all", "type_name", "manufacturer", F.col("device_0.vendor").alias("vendor"), F.col("device_0.serial").alias("serial"))


@query("SELECT id, 'HP' AS vendor, 'Ultrium 5-SCSI' AS model, 'F' || id % 100 AS firmware FROM tape_all", "tape")
def drive_inquiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.unhex(F.lit("0180061200000000")), F.rpad(F.lit("HP"), 8, " ").cast("binary"), F.rpad(F.lit("Ultrium 5-SCSI"), 16, " ").cast("binary"), F.rpad(F.concat(F.lit("F"), (F.col("id") % 100).cast("string")), 4, "\0").cast("binary"))
    return d.tapes(spark, sf_dir, live_only=False).select("id", values.inquiry(reply).alias("q")).select("id", "q.*")


#: Names under which queries over whole tables were registered when the plain names took subsets.
for _name in ("positions_by_file", "selection_size", "file_detail", "file_parents", "restore_tape_status", "job_finished", "duplicate_sources", "restore_plan"):
    QUERIES[f"{_name}_all"] = QUERIES[_name]
    if _name in ORACLES:
        ORACLES[f"{_name}_all"] = ORACLES[_name]

#: Iterative plans that SQL can't express; tests hold them against brute force.
WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLES))
