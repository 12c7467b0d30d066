"""Catalog tables derived from the star-schema test tables, so that every operator can run on them at any scale.

Ids of derived rows come from keys, never from a ranking over a whole table. Each view has SQL text of the same rows for
the checks in ``queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.functions import values
from shelfline.schema import DIR_BIT

DIR_MODE, FILE_MODE = DIR_BIT | 0o777, 0o644


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tapes(spark: SparkSession, sf_dir: str, live_only: bool = True) -> DataFrame:
    """Suppliers as tapes; every tenth was deleted."""
    s = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("id"), F.concat(F.lit("T"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("barcode"), F.col("s_name").alias("name"), F.floor(F.abs("s_acctbal") * 100).cast("long").alias("capacity_bytes"), (F.col("s_suppkey") % 7).alias("age"))
    return s.where("(id - 1) % 10 <> 0") if live_only else s


TAPE = """tape_all AS (
  SELECT s_suppkey + 1 AS id, 'T' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS barcode, s_name AS name,
         CAST(floor(abs(s_acctbal) * 100) AS BIGINT) AS capacity_bytes, s_suppkey % 7 AS age FROM supplier),
tape AS (SELECT * FROM tape_all WHERE (id - 1) % 10 <> 0)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as positions: the tape is the supplier, the file the part. Line items without a unique key get their place among equals."""
    li = load(spark, sf_dir, "lineitem")
    rest = [c for c in li.columns if c not in ("l_orderkey", "l_linenumber")]
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*rest))
    path = F.concat_ws("/", "l_returnflag", "l_linestatus", F.year("l_shipdate").cast("string"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")))
    return li.withColumn("nth", nth).select(((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + F.col("nth")).alias("id"), (F.col("l_partkey") + 1).alias("file_id"), (F.col("l_suppkey") + 1).alias("tape_id"), path.alias("path"), F.lit(FILE_MODE).cast("long").alias("mode"), F.col("l_shipdate").alias("mod_time"), F.col("l_shipdate").alias("write_time"), F.floor("l_quantity").cast("long").alias("size"), F.lit(None).cast("binary").alias("hash"))


POSITION = """position AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 64 + row_number() OVER (
           PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id,
         l_partkey + 1 AS file_id, l_suppkey + 1 AS tape_id,
         l_returnflag || '/' || l_linestatus || '/' || year(l_shipdate) || '/o' || l_orderkey AS path,
         l_shipdate AS mod_time, l_shipdate AS write_time, CAST(floor(l_quantity) AS BIGINT) AS size
  FROM lineitem)"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as flat files, the ones that positions are of; every 50th is a directory, with ids of which no position exists among them."""
    p = load(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("id"), F.lit(0).cast("long").alias("parent_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 50 == 0, DIR_MODE).otherwise(FILE_MODE).cast("long").alias("mode"), F.col("p_size").cast("long").alias("size"))
    return p


PART_FILE = f"""part_file AS (
  SELECT p_partkey * 2 + 1 AS id, 0 AS parent_id, p_name AS name, CASE WHEN p_partkey % 50 = 0 THEN {DIR_MODE} ELSE {FILE_MODE} END AS mode,
         CAST(p_size AS BIGINT) AS size FROM part)"""

_NO_TIME = "timestamp_ntz '1990-01-01 00:00:00'"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as directories, orders as files."""
    none = F.expr(_NO_TIME)

    def rows(table: str, id_: str, parent: str, name: str, mode: int = DIR_MODE, size: str = "0", time=none) -> DataFrame:
        return load(spark, sf_dir, table).select(F.expr(id_).cast("long").alias("id"), F.expr(parent).cast("long").alias("parent_id"), F.expr(name).alias("name"), F.lit(mode).cast("long").alias("mode"), time.alias("mod_time"), F.lit(None).cast("binary").alias("hash"), F.expr(size).cast("long").alias("size"), F.lit(None).cast("binary").alias("signature"))

    out = rows("region", "r_regionkey + 1", "0", "r_name")
    out = out.unionByName(rows("nation", "n_nationkey + 100", "n_regionkey + 1", "n_name"))
    out = out.unionByName(rows("customer", "c_custkey + 1000000", "c_nationkey + 100", "c_name"))
    return out.unionByName(rows("orders", "o_orderkey + 1000000000", "o_custkey + 1000000", "concat('order-', o_orderkey, '.tar.', substr(o_orderpriority, 1, 1))", FILE_MODE, "floor(o_totalprice)", F.col("o_orderdate")))


TREE = f"""tree AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS parent_id, r_name AS name, {DIR_MODE} AS mode, timestamp '1990-01-01' AS mod_time, CAST(0 AS BIGINT) AS size FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name, {DIR_MODE}, timestamp '1990-01-01', 0 FROM nation
  UNION ALL SELECT c_custkey + 1000000, c_nationkey + 100, c_name, {DIR_MODE}, timestamp '1990-01-01', 0 FROM customer
  UNION ALL SELECT o_orderkey + 1000000000, o_custkey + 1000000, 'order-' || o_orderkey || '.tar.' || substr(o_orderpriority, 1, 1), {FILE_MODE}, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) FROM orders)"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contents: hash and size of their text."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.unhex(F.sha2("text", 256)).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return d.withColumn("signature", values.signature(F.col("hash"), F.col("size")))


CONTENT = """content AS (
  SELECT doc_id, sha256(text) AS hash, strlen(text) AS size, upper('01' || sha256(text) || printf('%016x', strlen(text))) AS signature FROM documents)"""


def content_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents: files that the catalog knows."""
    c = contents(spark, sf_dir).where("doc_id % 2 = 0")
    return c.select((F.col("doc_id") + 1).alias("id"), F.lit(0).cast("long").alias("parent_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.lit(FILE_MODE).cast("long").alias("mode"), F.expr(_NO_TIME).alias("mod_time"), "hash", "size", "signature")


def content_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents: unlinked positions, on tapes of which some were deleted."""
    c = contents(spark, sf_dir).where("doc_id % 2 = 1")
    return c.select((F.col("doc_id") + 1).alias("id"), F.lit(0).cast("long").alias("file_id"), (F.col("doc_id") % 10 + 1).alias("tape_id"), F.concat(F.lit("d/"), (F.col("doc_id") % 5).cast("string"), F.lit("/doc"), F.col("doc_id").cast("string")).alias("path"), F.lit(FILE_MODE).cast("long").alias("mode"), F.expr(_NO_TIME).alias("mod_time"), F.expr(_NO_TIME).alias("write_time"), "size", "hash")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs."""
    o = load(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 17 == 0, 255).when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    made = values.to_nanos(F.col("o_orderdate"))
    return o.select((F.col("o_orderkey") + 1).alias("id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("long").alias("priority"), made.alias("create_time_ns"), (made + F.col("o_custkey") % 50 * 1_000_000_000).alias("update_time_ns"))


JOB = """job AS (
  SELECT o_orderkey + 1 AS id, CASE WHEN o_orderkey % 17 = 0 THEN 255 WHEN o_orderstatus = 'F' THEN 4 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END AS status,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority, epoch_us(o_orderdate) * 1000 AS create_time_ns,
         epoch_us(o_orderdate) * 1000 + o_custkey % 50 * 1000000000 AS update_time_ns FROM orders)"""


def archive_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, sources)``: an order's line items as a job's sources, in order."""
    s = positions(spark, sf_dir).withColumn("job", F.floor((F.col("id") - F.col("id") % 64) / 64 / 8).cast("long"))
    status = F.when(F.col("id") % 3 == 0, 4).when(F.col("id") % 3 == 1, 3).otherwise(1)
    return s.groupBy((F.col("job") + 1).alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "path", "size", status.alias("status")))), lambda x: F.struct(F.split(x["path"], "/").alias("path"), x["size"].alias("size"), x["status"].alias("status"), x["id"].alias("position_id"))).alias("sources"))


ARCHIVE = "source AS (SELECT id // 512 + 1 AS job_id, id, path, size, CASE id % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS status FROM position)"


def restore_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, tapes array<struct<tape_id,files>>)``: an order's line items by tape."""
    s = archive_states(spark, sf_dir).select("id", F.explode("sources").alias("s")).select("id", "s.*")
    t = s.groupBy("id", (F.col("position_id") % 3).alias("tape_id")).agg(F.sort_array(F.collect_list(F.struct("position_id", "size", "status"))).alias("files"))
    return t.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("tape_id", "files"))).alias("tapes"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, copied_bytes, copied_files, speed)`` of every fourth job."""
    return jobs(spark, sf_dir).where("id % 4 = 0").select("id", (F.col("id") % 13).alias("copied_bytes"), (F.col("id") % 2).alias("copied_files"), (F.col("id") % 5).alias("speed"))


LIVE = "live AS (SELECT id, id % 13 AS copied_bytes, id % 2 AS copied_files, id % 5 AS speed FROM job WHERE id % 4 = 0)"


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a job's progress: bytes copied so far."""
    e = load(spark, sf_dir, "events")
    so_far = F.sum(F.floor(F.abs("value") * 100).cast("long")).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.select(F.col("user_id").alias("job_id"), F.col("ts").alias("t"), so_far.alias("bytes"))


PROGRESS = """progress AS (
  SELECT user_id AS job_id, ts AS t, CAST(sum(CAST(floor(abs(value) * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes FROM events)"""


def steps_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(job_id, seq, step)``: a user's events as a job's steps."""
    e = load(spark, sf_dir, "events")
    step = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(1), F.lit(2), F.lit(255)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), step.alias("step"))


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, path)``: the path of a page's address, with some segments to clean."""
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), F.when(F.col("page_id") % 3 == 0, "/./x//../y.tar.gz").otherwise("")).alias("path"))


URL = "page_path AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') || CASE WHEN page_id % 3 = 0 THEN '/./x//../y.tar.gz' ELSE '' END AS path FROM pages)"
