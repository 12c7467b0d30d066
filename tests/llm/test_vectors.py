"""Vector links and neighbours against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from shelfline.llm import nearest, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, size int"


def table(spark, seed=1, n=400, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:160] = x[100] + 0.05 * rng.normal(size=(60, dim)).astype(np.float32)  # near copies
    x[200:230] = x[200]  # equal ones
    x[231] = 3 * x[200]
    rows = [(i, x[i].tolist(), int(i % 3), "", 0) for i in range(n)]
    odd = [(900, None, 1, "", 0), (901, [0.0] * dim, 1, "", 0), (902, [float("nan")] + [1.0] * (dim - 1), 1, "", 0), (903, [None] + [1.0] * (dim - 1), 1, "", 0), (904, [float("inf")] + [1.0] * (dim - 1), 1, "", 0), (905, x[100].tolist(), None, "", 0), (None, x[100].tolist(), 1, "", 0), (906, [1.0, 0.0], 1, "", 0), (907, [1.0, 0.0], 1, "", 0)]
    return rows + odd


def good(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)


def brute_links(rows, cosine=0.98):
    links = {k: [] for k in range(len(rows))}
    for a, (i, v, label, *_) in enumerate(rows):
        for b, (j, w, other, *_) in enumerate(rows):
            if a != b and None not in (i, j, label) and label == other and good(v) and good(w) and len(v) == len(w):
                p, q = np.float64(v), np.float64(w)
                if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= cosine:
                    links[a].append(b)
    group = {k: k for k in links}
    for _ in links:
        for a, bs in links.items():
            for b in bs:
                low = min(group[a], group[b], key=lambda k: rows[k][0])
                group[a] = group[b] = low
    return sorted(((rows[k][0], len(links[k]), rows[group[k]][0], rows[k][0] is None or rows[group[k]][0] == rows[k][0]) for k in links), key=repr)


@pytest.mark.parametrize("block", [2048, 32])
def test_near_vectors(spark, block):
    rows = table(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    out = vectors.near_vectors(df, block=block).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out), key=repr) == brute_links(rows)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_cover_tree_nests_and_halves():
    x = vectors.unit(np.random.default_rng(2).normal(size=(500, 3)))

    def check(node):
        assert vectors.distance(x[node.rows], x[node.center : node.center + 1]).max() <= node.radius + 1e-7
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            assert all(c.radius <= node.radius / 2 + 1e-7 for c in node.children)
            for c in node.children:
                check(c)

    root = vectors.cover_tree(x)
    assert root.children
    check(root)


def depth(node):
    return 1 + max(map(depth, node.children), default=0)


def test_trees_have_levels_on_the_tables(spark):
    """Trees of the test table's labels have levels below the root; on clustered vectors most pairs are never compared."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("embedding is not null and label is not null").collect()
    for label in {r["label"] for r in rows}:
        x = vectors.unit(np.array([r["embedding"] for r in rows if r["label"] == label], np.float64))
        assert depth(vectors.cover_tree(x)) >= 2
    rng = np.random.default_rng(8)
    x = vectors.unit(np.repeat(rng.normal(size=(60, 16)), 20, axis=0) + 0.05 * rng.normal(size=(1200, 16)))
    seen, one = Counter(), np.ones(1200, np.int64)
    links, _, _, _ = vectors.dual_links(x, x, one, one, 0.98, True, seen)
    hit = x @ x.T >= 0.98
    assert (links == hit.sum(1) - 1).all()
    assert depth(vectors.cover_tree(x)) >= 4
    assert seen["centres"] + seen["leaves"] < 0.1 * 1200 * 1199 / 2


def test_narrow_cells_and_labels_without_centres(spark):
    rng = np.random.default_rng(9)
    near = vectors.unit(np.ones((150, 6)) + 0.01 * rng.normal(size=(150, 6)))
    rows = [(i, near[i].astype(np.float32).tolist(), 0, "", 0) for i in range(150)] + [(1000 + i, rng.normal(size=6).astype(np.float32).tolist(), 1 + i, "", 0) for i in range(40)]
    rows += [(2000 + i, [1.0, 2.0], 7, "", 0) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = vectors.near_vectors(df, block=16, pivots=4).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out), key=repr) == brute_links(rows)


def test_folded_joins_keep_groups(monkeypatch):
    monkeypatch.setattr(vectors, "HELD", 50)
    rng = np.random.default_rng(3)
    x = vectors.unit(np.repeat(rng.normal(size=(4, 8)), 60, axis=0) + 0.02 * rng.normal(size=(240, 8)))
    one = np.ones(120, np.int64)
    nx, ny, ja, jb = vectors.dual_links(x[::2], x[1::2], one, one, 0.98, False)
    hit = x[::2] @ x[1::2].T >= 0.98
    assert (nx == hit.sum(1)).all() and (ny == hit.sum(0)).all()
    nodes, root = vectors.find_groups(ja, jb + 120)
    assert len(set(root)) == 4 and len(nodes) == 240


def brute_nearest(rows, asked, k):
    ok = [(i, np.float64(v)) for i, v, *_ in rows if i is not None and good(v)]
    return {i: sorted((-float((w * v).sum()), j) for j, w in ok if j != i and len(v) == len(w))[:k] for i, v in ok if asked(i)}


def test_neighbours(spark):
    rows = table(spark, n=600, dim=16)
    df = spark.createDataFrame(rows, SCHEMA)
    out = nearest.nearest(df, df.where("vec_id % 20 = 0"), k=20, shard_rows=250, block_queries=16).collect()
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    got: dict = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = {i: w for i, w in want.items() if w}
    assert set(got) == set(want)
    exact = {i: dict((j, s) for s, j in brute_nearest(rows, lambda x, i=i: x == i, 1000)[i]) for i in want}
    for i, found in got.items():
        assert found == sorted(found) and all(abs(exact[i][j] - s) < 1e-12 for s, j in found)
    hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    # the equal vectors 200..229 tie: the smaller ids come first
    assert [j for _, j in got[200]][1:] == list(range(201, 220)) and got[200][0][1] == 231
    few = df.where("vec_id < 5")
    assert nearest.nearest(few, few, k=20).groupBy("query_id").count().where("count = 4").count() == 5
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize(("dim", "spread"), [(64, 0.5), (256, 0.0)])
def test_searches_end_whole(dim, spread):
    """Unequal norms and many dimensions: a search that the radius doesn't end goes on to the rest of its shard."""
    rng = np.random.default_rng(1)
    x = vectors.unit(rng.normal(size=(3000, dim))) * np.exp(spread * rng.normal(size=3000))[:, None]
    shard = nearest.Shard(np.arange(3000), x, float(np.linalg.norm(x, axis=1).max()), 20)
    hits = 0
    for q in range(60):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(shard.search(x[q], q)[0].tolist()) & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.95 * 60 * 20


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    got: dict = {}
    for r in nearest.nearest(table, table.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[i] & {j for _, j in w}) for i, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_every_length_is_searched(spark):
    """A row of another length, first by id, doesn't keep the others out."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 0.0], 0, "", 0)] + [(i, rng.normal(size=8).astype(np.float32).tolist(), 0, "", 0) for i in range(1, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = nearest.nearest(df, df, k=5).collect()
    assert {r["query_id"] for r in found} == set(range(1, 60)) and len(found) == 59 * 5
