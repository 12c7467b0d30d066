"""Shared helpers: scratch tables, word hashing, distributed connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id given to a null doc_id where an order is needed: later than every real one.
NULL_ID = np.iinfo(np.int64).max
U64 = np.uint64


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary folder is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(spark, "_shelfline_scratch", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="shelfline-")
            spark._shelfline_scratch = folder
    return folder


def application_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Removes all tables that this application has materialized; DataFrames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Texts that a task turns into arrays at once: so many, and so many bytes of them; a longer text is taken alone.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20


def narrow_batches(df: DataFrame) -> DataFrame:
    """The same rows; where its session leaves the size of Arrow batches at Spark's default, they are bounded by bytes.

    Rows of long texts would else travel in batches of 64 MB, several of which a worker holds at a time."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "64MB", "-1b", "-1"):
        conf.set(key, str(BATCH_BYTES))
    return df


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most so many rows and, but for a single longer value, bytes of a text or binary column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        end = min(max(end, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


#: What a worker process remembers over tasks of one operator.
REMEMBERED_BY_WORKER: dict[tuple, object] = {}

Batches = Iterator[pa.RecordBatch]


def _give_back() -> None:
    """Freed memory goes back to the system, as far as the allocators can tell it apart."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def _forget() -> None:
    if REMEMBERED_BY_WORKER:
        REMEMBERED_BY_WORKER.clear()
        _give_back()


def tidy(run: Callable[[Batches], Batches], remembers: bool = False) -> Callable[[Batches], Batches]:
    """The same function of batches, in a worker that keeps no more memory than the function needs.

    Workers serve the tasks of all later stages, beside an executor whose heap is full by then. So what other operators
    remember goes first, unless this one ``remembers`` too, and what the task has freed is given back at its end."""

    def task(batches: Batches) -> Batches:
        if not remembers:  # a function of this module, as the task gets a copy of any value that it names itself
            _forget()
        yield from run(batches)
        _give_back()

    return task


def crc_mod(column: str, n: int) -> F.Column:
    """crc32(column as text) mod n, the fold of the learning operators; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def py_crc_mod(value: int | None, n: int) -> int:
    return 0 if value is None else zlib.crc32(str(value).encode()) % n


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: ASCII white space, which ends words; and a random value of each byte.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_powers = np.ones(1, U64)
#: Bytes that are hashed at once.
_BLOCK = 1 << 20


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, U64), np.cumprod(np.full(2 * n, 0xD6E8FEB86659FD93, U64))])
    return _powers


def _hash_block(raw: list[bytes], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    word = ~_SPACE[data]
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    bounds = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], bounds])))
    if not len(starts):
        return np.empty(0, U64), counts
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    h = np.add.reduceat(values[data[word]] * _power(int(size.max()))[place], first)
    return mix(h + size.astype(U64) * U64(0x2545F4914F6CDD1D)), counts


def text_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of all texts in a row, and each text's number of them.

    ``lower`` takes A-Z as a-z."""
    values = _LOWER_BYTE if lower else _BYTE
    hashes, counts, raw, size = [], [], [], 0
    for n, text in enumerate(texts, 1):
        raw.append((text or "").encode())
        size += len(raw[-1]) + 1
        if size >= _BLOCK or n == len(texts):
            h, c = _hash_block(raw, values)
            hashes.append(h)
            counts.append(c)
            raw, size = [], 0
    return (np.concatenate(hashes), np.concatenate(counts).astype(np.int64)) if hashes else (np.empty(0, U64), np.empty(0, np.int64))


def window_hashes(h: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (empty where there are fewer words)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    factors = mix(np.arange(width, dtype=U64) * U64(2) + U64(1 + 2**20 * seed)) | U64(1)
    acc = h[:n] * factors[0]
    for k in range(1, width):
        acc += h[k : k + n] * factors[k]
    return mix(acc)


def find_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links a-b: each node that occurs with the smallest node of its group."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


#: Links that a task reduces to stars at once.
TASK_LINKS = 500_000


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars, each group's smallest node with its others; in lots of TASK_LINKS."""
    a, b, held = [], [], 0

    def folded() -> pa.RecordBatch:
        node, root = find_groups(np.concatenate(a), np.concatenate(b))
        keep = node != root
        return pa.RecordBatch.from_arrays([pa.array(root[keep]), pa.array(node[keep])], names=["a", "b"])

    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held > 2 * TASK_LINKS:
            yield folded()
            a, b, held = [], [], 0
    if held:
        yield folded()


#: A key that holds a larger share of the rows than one in so many is joined by broadcast; fewer keys than that can.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, about: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``total`` rows joined with what is known about their keys: one row (keys, n, ...) each, n being the rows of a key.

    A key that a thousandth of all rows share would be one task's. There are less than a thousand such keys, so their
    part of ``about`` is broadcast, and only the rows of other keys are shuffled."""
    hot = F.col("n") * HOT_SHARE > total
    rest = rows.join(F.broadcast(about.where(hot).select(*keys)), keys, "left_anti").join(about.where(~hot), keys)
    return rows.join(F.broadcast(about.where(hot)), keys).unionByName(rest)


def components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """Connected components of the links ``(a long, b long)``: ``(node, component_id)``, the smallest node reachable.

    Links are dealt to tasks of some ``task_links`` each, which reduce theirs to stars, so a group of n links never costs
    more than n rows. Where the stars of different tasks meet, large-star and small-star rounds follow, on tables in the
    shared folder, until every node has one centre; they take about as many as the logarithm of the longest way between
    two nodes. Nodes without a link don't appear."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")

    def reduced(links: DataFrame, n: int) -> DataFrame:
        return materialize(links.repartition(max(1, -(-n // task_links))).mapInArrow(_stars, "a long, b long"), "links")

    def hub(links: DataFrame, n: int, down: bool) -> DataFrame:
        near = links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        if not down:
            near = near.unionByName(links.select(F.col("a").alias("node"), F.col("b").alias("other")))
        low = near.groupBy("node").agg(F.min("other").alias("low"), F.count("*").alias("n")).withColumn("low", F.least("low", "node"))
        if not down:
            near = near.where("other > node")
        moved = hot_join(near, low, ["node"], n).select("low", F.col("other").alias("x"))
        out = moved.unionByName(low.select("low", F.col("node").alias("x")))
        return out.where("x <> low").select(F.col("low").alias("a"), F.col("x").alias("b")).distinct()

    stars = reduced(edges, edges.count())
    while True:
        ends = stars.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(stars.select("a", F.lit(0), F.lit(1)).toDF("node", "below", "above"))
        odd = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1")
        if odd.isEmpty():
            return stars.select(F.col("b").alias("node"), F.col("a").alias("component_id")).unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("component_id")).distinct())
        # each star operation reads its links several times, so they are tables
        n = stars.count()
        stars = materialize(hub(materialize(hub(stars, n, down=False), "links"), n, down=True), "links")
        stars = reduced(stars, n)
