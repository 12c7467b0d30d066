"""Exact cosine links between embeddings by a dual traversal of cover trees.

Vectors are compared within a label (and a dimension). On the unit sphere a cosine bound is a distance bound, so:

1. Equal vectors of a label fall together by a pre-aggregated grouping.
2. The top level: at most ``PIVOTS`` vectors of all labels, chosen by a hash, are centres; each vector belongs to the
   nearest one of its label, whose covering radius is the largest distance of its own. A label of which none was chosen
   is one cell. Crowded cells are split into blocks; a cell so narrow that all its vectors are linked is a star instead.
3. A vector is sent to a pair of blocks only if the other cell's covering radius, and the plane between both centres,
   can be reached from it.
4. In each pair both blocks become cover trees: a node's children are a net of half its radius, down to single vectors
   or a few, so levels are nested and radii halve. Pairs of nodes are pruned if their centres are further apart than both
   covering radii and the bound, and counted whole if no pair of theirs can be beyond it. A few pairs of leaves are left,
   which are compared in double precision.

What pruning saves depends on the vectors: where few lie near each other, as in the test tables, the first net holds
almost each of them, and the distances between its centres are all there is to compute.

The driver keeps the chosen centres, at most ``PIVOTS``. A task emits one row a vector, its number of links and the
smallest vector of its group, never its pairs.

Nulls: a vector that is null, all zero or holds a null or non-finite component, and one with a null label, is linked with
nothing. A row with a null id is its own group. Rows that share an id are one vector in groups, while each counts as a
link. Vectors of different lengths are never linked. A cosine of exactly the bound is a link. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import components, find_groups, hot_join, materialize

COSINE, BLOCK, PIVOTS, LEAF, SLACK = 0.98, 2048, 4096, 8, 1e-7
#: Joins that a traversal holds before it folds them into stars.
HELD = 1 << 18


def usable(embedding: F.Column) -> F.Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ c.T)))


class Node:
    __slots__ = ("center", "children", "radius", "rows")

    def __init__(self, center: int, rows: np.ndarray, radius: float, children: list[Node]) -> None:
        self.center, self.rows, self.radius, self.children = center, rows, radius, children


def net(x: np.ndarray, rows: np.ndarray, first: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of the rows its centre in a net of the radius (centres lie further apart), and its distance from it.

    ``first`` is the first centre; the others follow in order of the rows, each taking what is still free around it."""
    rows = np.concatenate([[first], rows[rows != first]])
    near = x[rows] @ x[rows].T
    hit = near >= 1 - radius * radius / 2
    hit[np.diag_indices(len(rows))] = True
    owner = np.arange(len(rows))
    free = np.ones(len(rows), bool)
    for i in np.flatnonzero(hit.sum(axis=1) > 1).tolist():
        if free[i]:
            own = free & hit[i]
            owner[own] = i
            free &= ~own
    far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * near[np.arange(len(rows)), owner]))
    far[owner == np.arange(len(rows))] = 0.0
    return rows, np.stack([rows[owner], far.view(np.int64)])


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, center: int = 0) -> Node:
    """A node covers its rows from one of them; its children, a net of half its radius, cover them each with no more than that."""
    rows = np.arange(len(x)) if rows is None else rows
    radius = float(distance(x[rows], x[center : center + 1]).max()) if len(rows) > 1 else 0.0
    if len(rows) <= LEAF or radius <= SLACK:
        return Node(center, rows, radius, [])
    rows, (owner, _) = net(x, rows, center, radius / 2)
    order = np.argsort(owner, kind="stable")
    heads, at = np.unique(owner[order], return_index=True)
    parts = np.split(rows[order], at[1:])
    return Node(center, rows, radius, [cover_tree(x, own, head) for head, own in zip(heads.tolist(), parts, strict=True)])


def dual_links(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, cosine: float, same: bool, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of x's rows and of y's (each counting the other's weight), and joins of a row of x and one of y that span the groups.

    ``seen`` counts distances between centres and in leaves, and pairs of vectors that were pruned or counted whole."""
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    seen = Counter() if seen is None else seen
    nx, ny, ja, jb = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), [], []
    a = cover_tree(x)
    stack = [(a, a if same else cover_tree(y))]

    def fold(ja: list[np.ndarray], jb: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same groups with at most one join a row; rows of y count from len(x) meanwhile, and joins stay between x and y."""
        named, root = find_groups(np.concatenate(ja), np.concatenate(jb) + (0 if same else len(x)))
        if same:
            return [named], [root]
        # a group's smallest row is one of x; its rows of x meet at its first row of y
        from_y = named >= len(x)
        tops, first = np.unique(root[from_y], return_index=True)
        y_of = named[from_y][first] - len(x)
        return [root[from_y], named[~from_y]], [named[from_y] - len(x), y_of[np.searchsorted(tops, root[~from_y])]]

    def pairs(ps: list[Node], qs: list[Node], upper: bool) -> list[tuple[Node, Node]]:
        """Of the pairs of nodes those that the covering radii don't rule out; pairs of single vectors are settled here."""
        nonlocal ja, jb
        pc, qc, pr, qr = (np.array([getattr(n, k) for n in ns]) for k in ("center", "radius") for ns in (ps, qs))
        near = x[pc] @ y[qc].T
        # at most so far apart, by the row's own radius and the largest of the others; then by both
        bound = pr + qr.max() + reach + SLACK
        i, j = np.nonzero(near >= (1.0 - bound * bound / 2)[:, None])
        far = pr[i] + qr[j] + reach + SLACK
        keep = near[i, j] >= 1.0 - far * far / 2
        if upper:
            keep &= i < j
        seen["centres"] += near.size // 2 if upper else near.size
        i, j = i[keep], j[keep]
        one_p, one_q = (np.array([len(n.rows) == 1 for n in ns]) for ns in (ps, qs))
        single = one_p[i] & one_q[j]
        hit = single & (near[i, j] >= cosine)
        if hit.any():
            u, v = pc[i[hit]], qc[j[hit]]
            np.add.at(nx, u, sy[v])
            np.add.at(nx if same else ny, v, sx[u])
            ja.append(u)
            jb.append(v)
            if sum(map(len, ja)) > HELD:
                ja, jb = fold(ja, jb)
        return [(ps[k], qs[m]) for k, m in zip(i[~single].tolist(), j[~single].tolist(), strict=True)]

    while stack:
        p, q = stack.pop()
        own = same and p is q
        d = 0.0 if own else float(distance(x[p.center : p.center + 1], y[q.center : q.center + 1])[0, 0])
        if d > p.radius + q.radius + reach + SLACK:
            seen["pruned"] += len(p.rows) * len(q.rows)
            continue
        if (2 * p.radius if own else d + p.radius + q.radius) <= reach - SLACK:
            seen["whole"] += len(p.rows) * (len(p.rows) - 1) // 2 if own else len(p.rows) * len(q.rows)
            nx[p.rows] += int(sy[q.rows].sum())
            if own:
                nx[p.rows] -= sx[p.rows]
            else:
                (nx if same else ny)[q.rows] += int(sx[p.rows].sum())
            ja += [p.rows, np.full(len(q.rows), p.rows[0])]
            jb += [np.full(len(p.rows), q.rows[0]), q.rows]
        elif not p.children and not q.children:
            seen["leaves"] += len(p.rows) * (len(p.rows) - 1) // 2 if own else len(p.rows) * len(q.rows)
            hit = x[p.rows] @ y[q.rows].T >= cosine
            if own:
                hit[np.diag_indices(len(hit))] = False
            if hit.any():
                nx[p.rows] += hit @ sy[q.rows]
                if not own:
                    (nx if same else ny)[q.rows] += sx[p.rows] @ hit
                i, j = np.nonzero(np.triu(hit) if own else hit)
                ja.append(p.rows[i])
                jb.append(q.rows[j])
                if sum(map(len, ja)) > HELD:
                    ja, jb = fold(ja, jb)
        elif own:
            stack += [(kid, kid) for kid in p.children if len(kid.rows) > 1] + pairs(p.children, p.children, True)
        elif p.children and (p.radius >= q.radius or not q.children):
            stack += pairs(p.children, q.children or [q], False)
        else:
            stack += pairs(p.children or [p], q.children, False)
    empty = np.empty(0, np.int64)
    return nx, ny, np.concatenate(ja) if ja else empty, np.concatenate(jb) if jb else empty


def near_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """``(id, n_links, component_id, kept)`` a row of the table."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    name = [F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit(3), "label", "v").alias("k2")]
    rows = rows.select("id", "ok", *[F.when(F.col("ok"), k).alias(n) for n, k in zip(("k1", "k2"), name, strict=True)], "label", "v")
    classes = rows.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = materialize(classes.withColumn("dim", F.size("v")), "classes")
    crowds = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = classes.count()
    # a centre for each block that is to be, at most `pivots`, of labels that need several blocks
    share = min(1.0, 1 / block, pivots / max(1, total))
    drawn = classes.where(F.pmod(F.xxhash64(F.lit(11), "node"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("label", "dim", "node", "v").orderBy("node").limit(pivots).collect()
    lists: dict[tuple, list] = {}
    for r in drawn:
        lists.setdefault((r["label"], r["dim"]), []).append(r["v"])
    centers, start = {}, {}
    for key in sorted(lists):
        start[key] = sum(map(len, centers.values()))
        centers[key] = unit(np.array(lists[key], np.float64))
    apart = {key: distance(c, c) for key, c in centers.items()}

    def keyed(batch: pa.RecordBatch, size: int = 1024) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """Runs of rows of one label and dimension."""
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            own: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(part.column("label").to_pylist(), part.column("dim").to_pylist(), strict=True)):
                own.setdefault(key, []).append(i)
            for key, rows_ in own.items():
                yield key, part.take(pa.array(rows_))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in (x for batch in batches for x in keyed(batch)):
            cell, far = np.full(part.num_rows, -1), np.zeros(part.num_rows)
            if key in centers:
                d = distance(unit(matrix(part.column("v"))), centers[key])
                cell, far = start[key] + d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), *part.columns], names=["cell", "far", *part.schema.names])

    several = hot_join(classes.select("label", "dim", "node", F.col("n").alias("size"), "v"), crowds, ["label", "dim"], total)
    several = several.select("label", "dim", F.col("n").alias("crowd"), "node", "size", "v")
    cells = materialize(several.mapInArrow(assign, "cell long, far double, label string, dim int, crowd long, node long, size long, v array<double>"), "cells")
    about = {r["cell"]: r for r in cells.where("cell >= 0").groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n"), F.sum("size").alias("weight"), F.min("node").alias("low")).collect()}
    reach = float(np.sqrt(2.0 - 2.0 * cosine)) + SLACK
    n_cells = sum(map(len, centers.values()))
    # cells without vectors lie beyond all reach
    radius = np.array([about[c]["far"] if c in about else -np.inf for c in range(n_cells)])
    blocks = np.array([-(-about[c]["n"] // block) if c in about else 0 for c in range(n_cells)])
    narrow = 2 * radius <= reach - 2 * SLACK

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in (x for batch in batches for x in keyed(batch, 256)):
            cell, node = part.column("cell").to_numpy(), part.column("node").to_numpy()
            if key in centers:
                at = slice(start[key], start[key] + len(centers[key]))
                d, mine = distance(unit(matrix(part.column("v"))), centers[key]), cell - start[key]
                own = d[np.arange(len(d)), mine][:, None]
                hit = (d <= radius[at] + reach) & (d * d - own * own <= 2 * apart[key][mine] * reach + SLACK)
                hit[np.arange(len(d)), mine] = ~narrow[cell]
                i, k = np.nonzero(hit)
                k += start[key]
                many, here = blocks[k], blocks[cell]
            else:
                i, k = np.arange(len(cell)), cell
                many = here = -(-part.column("crowd").to_numpy() // block)
            i, k, many = np.repeat(i, many), np.repeat(k, many), many
            b = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            c, m = cell[i], (((node * 2654435761) & 0xFFFFFFFF) % here)[i]
            lower = (c < k) | (c == k) & (m <= b)
            cols = [np.where(lower, p, q) for p, q in ((c, k), (m, b), (k, c), (b, m))]
            for at in range(0, len(i), 4096):
                s = slice(at, at + 4096)
                sent = part.take(pa.array(i[s]))
                yield pa.RecordBatch.from_arrays([*(pa.array(z[s]) for z in cols), pa.array(lower[s]), *(sent.column(z) for z in ("label", "dim", "node", "size", "v"))], names=["a", "ab", "b", "bb", "lower", "label", "dim", "node", "size", "v"])

    def compare(pair: pa.Table) -> pa.Table:
        same = pair["a"][0].as_py() == pair["b"][0].as_py() and pair["ab"][0].as_py() == pair["bb"][0].as_py()
        node, size, lower = (pair[c].to_numpy() for c in ("node", "size", "lower"))
        v = unit(matrix(pair["v"]))
        x, y = (np.flatnonzero(lower), np.flatnonzero(~lower)) if not same else (np.arange(len(node)),) * 2
        links = np.zeros(len(node), np.int64)
        hub = node.copy()
        if len(x) and len(y):
            nx, ny, ja, jb = dual_links(v[x], v[y], size[x], size[y], cosine, same)
            links[x] += nx
            links[y] += ny
            if len(ja):
                named, root = find_groups(node[x][ja], node[y][jb])
                place = np.searchsorted(named, node)
                place[place == len(named)] = 0
                hub = np.where(named[place] == node, root[place], node)
        keep = links > 0
        return pa.table({"node": node[keep], "links": links[keep], "hub": hub[keep]})

    found = cells.mapInArrow(send, "a long, ab long, b long, bb long, lower boolean, label string, dim int, node long, size long, v array<double>")
    found = found.groupBy("label", "dim", "a", "ab", "b", "bb").applyInArrow(compare, "node long, links long, hub long")
    if any(narrow[c] for c in about):
        # at most `pivots` cells
        stars = table.sparkSession.createDataFrame([(c, r["weight"], r["low"]) for c, r in about.items() if narrow[c]], "cell long, weight long, hub long")
        found = found.unionByName(cells.join(F.broadcast(stars), "cell").select("node", (F.col("weight") - F.col("size")).alias("links"), "hub").where("links > 0"))
    found = materialize(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    classes = classes.select("k1", "k2", "node", "n").join(links, "node", "left").join(parts, "node", "left")
    about_ = classes.select("k1", "k2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component"))
    result = hot_join(rows.where("ok").select("id", "k1", "k2"), about_, ["k1", "k2"], rows.count()).select("id", "n_links", "component")
    result = result.unionByName(rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return result.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
