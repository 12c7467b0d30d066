"""Approximate nearest neighbours by collision counting over single projections.

Inner products become distances on a sphere: a vector x of norm at most M gets one more component, sqrt(M^2 - |x|^2),
a query none. The rows are dealt to shards by a hash; a shard keeps its distinct vectors' values of each of ``count``
random projections as a sorted array, and each vector's rank in it. A query's window, centred on its own value, grows by
virtual rehashing: round by round it is as much wider as the radius is. Two binary searches an array give the ranks that
the window holds, and a vector whose rank lies between them collides; ranks are kept as 256ths of the shard's size, a
byte each, and windows are rounded to them. Vectors with more than ``THRESHOLD * count``
collisions are verified by their inner product. A query stops in a shard once its k-th best verified vector lies within
the radius. Where more than ``SHARE`` of the shard would be verified before that, the windows no longer rule much out,
and the rest of the shard is verified too, so nothing is cut off.

Every row is indexed: the projections don't depend on the data, and the largest norm is taken over all rows. The first
radius is a little below the distance of the k-th nearest that some rows of the shard have among all of it. Queries and
shards meet block by block, so a task holds one shard and one block of queries whatever the size of the tables; what it
takes to sort a shard's arrays again for each block is a few hundredths of what 4,096 searches take. A shard sends the k
best of each query; equal vectors are one entry with all their ids, so a hot vector costs one.

Nulls: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows with a null id, as
queries or candidates. Vectors of several dimensions are searched each among its own kind. Ties go to the smaller id. A
query's own id is never its neighbour; repeated query rows count once. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import hot_join, materialize
from shelfline.llm.vectors import matrix, usable

PROJECTIONS, THRESHOLD, FIRST, GROWTH, SHARE, STEPS = 192, 0.627, 0.95, 1.07, 0.2, 256
SHARD_ROWS, BLOCK_QUERIES = 16384, 4096


def projections(dim: int, count: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, count))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows with one vector, each summed in the same order wherever its row stands."""
    return (x * q).sum(axis=1)


class Shard:
    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float, k: int, count: int = PROJECTIONS) -> None:
        self.x, inverse = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, inverse.ravel()))
        self.ids, owner = ids[order], inverse.ravel()[order]
        self.start = np.searchsorted(owner, np.arange(len(self.x) + 1))
        n, self.top, self.k, self.verified, self.whole = len(self.x), top, k, 0, 0
        rest = np.sqrt(np.maximum(0.0, top * top - (self.x**2).sum(axis=1)))
        self.lines = projections(x.shape[1] + 1, count)
        values = (np.c_[self.x, rest] @ self.lines).T
        by_value = np.argsort(values, axis=1, kind="stable")
        self.rank = np.empty(values.shape, np.uint8)
        np.put_along_axis(self.rank, by_value, np.broadcast_to((np.arange(n) * STEPS // n).astype(np.uint8), values.shape), axis=1)
        # the arrays one after the other, each moved beyond the one before, so that one search finds all ends of a window
        self.gap = 2 * float(np.abs(values).max()) + 16 * top
        self.shift = np.arange(count) * self.gap
        self.flat = (np.take_along_axis(values, by_value, axis=1) + self.shift[:, None]).ravel()
        self.base = np.arange(count) * n
        self.moved, self.inside = np.empty((count, n), np.uint8), np.empty((count, n), bool)
        some = self.x[:: -(-n // 32)]
        near = 2 * top * (top - np.partition(some @ self.x.T / np.sqrt((some**2).sum(axis=1))[:, None], max(0, n - k - 1), axis=1)[:, max(0, n - k - 1)])
        self.first = max(FIRST * float(np.sqrt(max(0.0, float(np.median(near))))), 0.05 * top)

    def collisions(self, middle: np.ndarray, radius: float) -> np.ndarray:
        """How many arrays hold each vector within the query's window."""
        low = np.searchsorted(self.flat, middle - radius) - self.base
        high = np.searchsorted(self.flat, middle + radius, "right") - self.base
        low = np.minimum(low * STEPS // len(self.x), STEPS - 1)
        last = np.maximum(-(-high * STEPS // len(self.x)) - 1, low)
        # ranks below the window wrap round to large numbers
        np.subtract(self.rank, low.astype(np.uint8)[:, None], out=self.moved)
        np.less_equal(self.moved, (last - low).astype(np.uint8)[:, None], out=self.inside)
        return np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8 if len(self.rank) < 256 else np.uint16)

    def search(self, q: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k nearest found."""
        n, m, k = len(self.x), len(self.rank), self.k
        scale = self.top / np.sqrt((q * q).sum())
        middle = np.clip((q * scale) @ self.lines[:-1], -self.gap / 4, self.gap / 4) + self.shift
        radius, found, score = self.first, 0, np.full(n, -np.inf)
        while found < n:
            fresh = np.flatnonzero((self.collisions(middle, radius) > THRESHOLD * m) & np.isneginf(score))
            found += len(fresh)
            if found > SHARE * n or radius > 4 * self.top:
                found, score = n, self.x @ q
                self.whole += 1
                break
            score[fresh] = self.x[fresh] @ q
            # distance of the k-th best, one more for the query's own row
            if found > k and 2 * self.top**2 - 2 * scale * np.partition(score, n - k - 1)[n - k - 1] <= radius**2:
                break
            radius *= GROWTH
        self.verified += found
        # what may be among the k + 1 best is summed once more, in the same order everywhere
        floor = np.partition(score, n - k - 1)[n - k - 1] if n > k else -np.inf
        best = np.flatnonzero((score >= floor - 1e-9 * self.top / scale) & ~np.isneginf(score))
        rows = []
        for f, s in zip(best.tolist(), products(self.x[best], q).tolist(), strict=True):
            # of equal vectors only the k + 1 smallest ids can be among the k nearest
            rows += [(-s, i) for i in self.ids[self.start[f] : min(self.start[f + 1], self.start[f] + k + 1)].tolist() if i != own]
        rows.sort()
        return np.array([i for _, i in rows[:k]], np.int64), np.array([-s for s, _ in rows[:k]])


def nearest(table: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, count: int = PROJECTIONS) -> DataFrame:
    """``(query_id, rank from 1, vec_id, score)``: the k nearest found of each query by inner product."""

    def vectors(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return df.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))

    rows, asked = vectors(table), vectors(queries).distinct()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    kinds = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("top")).join(asked.groupBy("dim").agg(F.count("*").alias("asked")), "dim")
    kinds = materialize(kinds.withColumns({"shards": F.ceil(F.col("n") / shard_rows), "blocks": F.ceil(F.col("asked") / block_queries)}), "kinds")
    total = kinds.agg(F.sum("n")).first()[0] or 0
    place = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.col(of)).cast("int")  # noqa: E731  spreads equal ids and equal vectors alike
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of).cast("int") - 1))
    index = hot_join(rows, kinds, ["dim"], total).select("dim", place(1, "shards").alias("shard"), each("blocks").alias("block"), "id", "v", "top")
    asked = hot_join(asked, kinds, ["dim"], total).select("dim", each("shards").alias("shard"), place(2, "blocks").alias("block"), "id", "v")

    def search(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if ours.num_rows and theirs.num_rows:
            shard = Shard(ours["id"].to_numpy(), matrix(ours["v"]), ours["top"][0].as_py(), k, count)
            for own, q in zip(theirs["id"].to_pylist(), matrix(theirs["v"]), strict=True):
                ids, scores = shard.search(q, own)
                out += [(own, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    by = ["dim", "shard", "block"]
    found = index.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
