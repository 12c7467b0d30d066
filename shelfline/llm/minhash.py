"""Near-duplicate documents by SuperMinHash, banding, verification on full shingle sets and grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import U64, components, hot_join, materialize, mix, narrow_batches, slices, text_words, tidy, window_hashes
from shelfline.llm.lines import bit_map, marked

BANDS, ROWS = 32, 4
#: Members of a bucket that one task checks against its hubs.
SLICE = 1024
#: Words of 64 bits in a set's bitmap.
BITMAP_LONGS = 16


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of the runs of ``width`` lower-cased (A-Z) words; of all its words as one run where there are fewer."""
    h, counts = text_words(texts, lower=True)
    runs = window_hashes(h, width)
    out = []
    for end, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
        out.append(np.unique(runs[end - n : end - width + 1]) if n >= width else window_hashes(h[end - n : end], n, 2 + n) if n else np.empty(0, U64))
    return out


def super_minhash(doc: np.ndarray, elements: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Signatures (docs x size) of the sets given as (document, element) rows.

    Each element has a random permutation of the places; the j-th value that it offers lies in [j, j + 1), at the
    j-th place of the permutation. Levels run side by side over all elements; a document stops at the first level
    after which every place holds a value below the next level, since no later offer can win."""
    best = np.full(docs * size, np.inf)
    swapped: list[np.ndarray] = []  # the index that each earlier level drew
    moved: list[np.ndarray] = []  # and what it put there
    for j in range(size):
        if not len(doc):
            break
        x = mix(elements + U64((0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64))
        y = mix(x + U64(0xD1B54A32D192ED03))
        drawn = j + ((y >> U64(32)) % U64(size - j)).astype(np.int64)
        place, own = drawn.copy(), np.full(len(doc), j)
        for k, v in zip(swapped, moved, strict=True):
            place = np.where(drawn == k, v, place)
            own = np.where(k == j, v, own)
        np.minimum.at(best, doc * size + place, j + (x >> U64(11)).astype(np.float64) * 2.0**-53)
        active = np.unique(doc)
        full = best.reshape(docs, size)[active].max(axis=1) < j + 1
        if full.any():
            done = np.zeros(docs, bool)
            done[active[full]] = True
            keep = ~done[doc]
            doc, elements, drawn, own = doc[keep], elements[keep], drawn[keep], own[keep]
            swapped, moved = [k[keep] for k in swapped], [v[keep] for v in moved]
        swapped.append(drawn)
        moved.append(own)
    return best.reshape(docs, size)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band; equal keys of different bands stay apart."""
    docs, size = signatures.shape
    raw = signatures.view(U64).reshape(docs, bands, size // bands)
    acc = np.broadcast_to(mix(np.arange(bands, dtype=U64) + U64(77)), (docs, bands)).copy()
    for r in range(raw.shape[2]):
        acc = mix(acc * U64(0x9E3779B97F4A7C15) + raw[:, :, r])
    return acc


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """``(id, n_shingles, set1, set2, keys)``: the size of each set, two sums that name it, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sets = shingle_sets(batch.column(1).to_pylist(), width)
                sizes = np.array([len(s) for s in sets], np.int64)
                doc = np.repeat(np.arange(len(sets)), sizes)
                elements = np.concatenate(sets)
                named = []
                for seed in (0, 0x51AFD7ED558CCD6D):
                    total = np.zeros(len(sets), U64)
                    np.add.at(total, doc, mix(elements ^ U64(seed)))
                    named.append(total.view(np.int64))
                keys = band_keys(super_minhash(doc, elements, len(sets), bands * rows), bands).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *map(pa.array, named), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))], names=["id", "n_shingles", "set1", "set2", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "id long, n_shingles long, set1 long, set2 long, keys array<long>")


def stored_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(node, size, members, bits)``: the whole shingle sets of the documents in ``wanted`` (node), with size and a bitmap of each by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sets = shingle_sets(batch.column(1).to_pylist(), width)
                bits = np.zeros((len(sets), BITMAP_LONGS * 64), bool)
                for row, s in zip(bits, sets, strict=True):
                    row[mix(s + U64(99)) % U64(BITMAP_LONGS * 64)] = True
                longs = np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.FixedSizeListArray.from_arrays(pa.array(longs), BITMAP_LONGS).cast(pa.list_(pa.int64()))], names=["node", "size", "members", "bits"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    # only texts that may be wanted go through the shuffle
    texts = marked(texts, bit_map(wanted, "node"), "node").where("hit").drop("hit")
    return texts.join(wanted, "node", "left_semi").mapInArrow(tidy(run), "node long, size long, members array<long>, bits array<long>")


def held(sets: DataFrame, column: str, nodes: DataFrame, node: str = "node") -> DataFrame:
    """``(node, column)`` of the sets that a bitmap of the nodes in ``nodes`` hits: all of theirs and few others, without a shuffle."""
    rows = marked(sets.select("node", F.col(column).alias("held")), bit_map(nodes.select(F.col(node).alias("node")), "node"), "node")
    return rows.where("hit").select("node", F.col("held").alias(column))


def at_most_common(n: Column, x: str, m: Column, y: str) -> Column:
    """The most shingles that sets of n and m can share by their bitmaps x and y: a bit that only one has is a shingle that only that set has."""
    only = lambda x, y: sum((F.bit_count(F.col(x)[k].bitwiseAND(F.bitwise_not(F.col(y)[k]))) for k in range(BITMAP_LONGS)), F.lit(0))
    return F.least(n - only(x, y), m - only(y, x))


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) without those that sizes and bitmaps rule out, so that no whole set travels for them."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits"))
    n, m = F.col("a_size"), F.col("b_size")
    common = at_most_common(n, "a_bits", m, "b_bits")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * common >= percent * (n + m - common)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), a stored table, those whose whole sets reach the threshold: 100 * intersection >= percent * union.

    The sets meet pair by pair inside the JVM: no batch of them ever travels to a worker. Only sets of the pairs are shuffled."""
    side = lambda x, name: held(sets, "members", pairs, x).select(F.col("node").alias(x), F.col("members").alias(name))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    n, m, common = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    suits = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return both.where(F.when(suits, 100 * common >= percent * (n + m - common)).otherwise(False)).select("a", "b")


def shared_sizes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, bits, shared)``: the bitmap, and how many shingles of each node (node, n_shingles) some other of the nodes has too, at least.

    Sets of other nodes that ``held`` lets through may add to that, which is a bound either way; so no set is shuffled whole."""
    rows = held(sets, "members", nodes).select(F.explode("members").alias("shingle"), "node")
    own = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(F.count("*").alias("own"))
    return nodes.join(own, "node", "left").join(held(sets, "bits", nodes), "node").select("node", "bits", (F.col("n_shingles") - F.coalesce("own", F.lit(0))).alias("shared"))


def _slices() -> Column:
    return F.ceil(F.col("n") / SLICE).cast("int")


def sliced(rows: DataFrame, about: DataFrame) -> DataFrame:
    """Rows (key, n, slice) joined with about (key, n, ...), whose rows are copied to each slice of their bucket.

    A bucket of n rows has n / SLICE slices, so no task gets more than some of them, however many rows share a key."""
    copies = about.withColumn("slice", F.explode(F.sequence(F.lit(0), _slices() - 1))).drop("n")
    return rows.join(copies, ["key", "slice"])


def _reaching(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (key, slice, n, node, group, n_shingles, slack) that some row of another group in their bucket can be linked with.

    Sets of n and m with at most s and r shared shingles can be linked only if both slacks, (100 + percent) * s - percent * n
    and the other's, reach percent times the other's size. So a row needs a size and a slack outside its group that
    suit its own; the best of each is found with the best group's and the best of all other groups'. A group's best come
    first, so that the best of all others is a second small grouping and the rows are joined once."""
    groups = materialize(rows.groupBy("key", F.col("n").alias("members"), "group").agg(F.min("n_shingles").alias("least"), F.max("slack").alias("most")), "groups-of-buckets")
    keys = ["key", "members"]
    top = groups.groupBy(*keys).agg(F.min(F.struct("least", "group")).alias("small"), F.max(F.struct("most", "group")).alias("wide"), F.count("*").alias("n"))
    others = hot_join(groups, top, keys, groups.count()).groupBy("key", F.col("members").alias("n")).agg(
        F.min(F.when(F.col("group") != F.col("small.group"), F.col("least"))).alias("next_small"), F.max(F.when(F.col("group") != F.col("wide.group"), F.col("most"))).alias("next_wide"),
        F.first("small").alias("small"), F.first("wide").alias("wide"))
    rows_ = sliced(rows, others)
    small = F.when(F.col("group") != F.col("small.group"), F.col("small.least")).otherwise(F.col("next_small"))
    wide = F.when(F.col("group") != F.col("wide.group"), F.col("wide.most")).otherwise(F.col("next_wide"))
    return rows_.where((F.col("slack") >= percent * small) & (wide >= percent * F.col("n_shingles"))).select(*rows.columns)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, hubs: int = 4) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` a row of ``docs``; linked are sets with 100 * intersection >= percent * union.

    Rows with one shingle set fall together first, by a pre-aggregated grouping. Of the distinct sets, those that share
    a band key are candidates: at the threshold 0.8 and 32 bands of 4 rows, 5 pairs in 100 million are missed. A band
    bucket isn't expanded into all its pairs. Its most central set (the one with most mass over all its buckets) is
    checked against all members that its size and bitmap allow, and links group the sets. Buckets that still hold several
    groups go on:

    * Of each set left in one, the shingles are counted that no other such set has. A set of n with s shared ones reaches
      at most s / (n + m - s) with a set of m; members that can't reach the threshold with any other group of their
      bucket leave it. This rules out the distant copies of a large group without comparing them.
    * More members become hubs, each round eight times as many, and are checked against the members of other groups that
      this bound and another one from bitmaps of both sets allow.

    That ends when each bucket is one group or all that can be linked in it is checked. So a group of n near copies costs
    about n checks, and no link between two groups is lost. Every link is confirmed on whole sets. Buckets are split
    into slices of their members, to which hubs are copied, so a bucket's size doesn't matter to a task. Keys that no other
    set has and sets that no pair needs are kept out of shuffles by broadcast maps of a fixed size.

    Nulls: a null or empty text has an empty set and is linked with nothing. A null id has no links, a null component
    and is kept. Rows that share an id are one document with several texts. Of equal sizes and masses the smaller id
    leads, so ties and repeated rows don't change the result. Texts are read whole, in slices of a bounded number of
    bytes; a single longer text is taken alone. Other columns are not read. An empty table gives an empty result."""
    docs = narrow_batches(docs)
    own = materialize(signatures(docs, id_col, text_col, width, bands, rows), "signatures")
    real = own.where("n_shingles > 0 and id is not null")
    classes = materialize(real.groupBy("set1", "set2", "n_shingles").agg(F.min("id").alias("node"), F.first("keys").alias("keys"), F.count("*").alias("n")), "classes")
    exploded = classes.select("node", "n_shingles", F.explode("keys").alias("key"))
    crowds = materialize(exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    # keys that no other set has don't go through the join's shuffle
    exploded = marked(exploded, bit_map(crowds, "key"), "key").where("hit").drop("hit")
    members = materialize(hot_join(exploded, crowds, ["key"], classes.count() * bands), "buckets")
    mass = members.groupBy("node").agg(F.sum("n").alias("mass"))
    sets = materialize(stored_sets(docs, mass.select("node"), id_col, text_col, width), "sets")
    central = F.struct((-F.col("mass")).alias("order"), "node")
    slice_ = F.pmod(F.xxhash64(F.lit(21), "node"), _slices()).cast("int")
    open_ = materialize(members.join(mass, "node").withColumns({"group": F.col("node"), "slice": slice_}), "members")
    lead = open_.groupBy("key", "n").agg(F.min(central).alias("hub")).select("key", "n", F.col("hub.node").alias("hub"))
    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = possible(ordered(sliced(open_, lead).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))), sets, percent)
    group, turn = None, 0
    u = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(1 << 30)
    while True:
        found = materialize(verified(materialize(pairs, "pairs"), sets, percent), "verified")
        # what is grouped already goes on as one star a group
        links = found if group is None else found.unionByName(group.where("node <> component_id").select(F.col("component_id").alias("a"), F.col("node").alias("b")))
        if group is None or not found.isEmpty():
            group = materialize(components(links), "groups")
        turn += 1
        now = open_.drop("group").join(group, "node", "left").withColumn("group", F.coalesce("component_id", "node")).drop("component_id")
        several = now.groupBy("key", "n").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key", "n")
        now = materialize(sliced(now.drop("shared", "slack", "u", "bits"), several), "open")
        if now.isEmpty():
            break
        shared = shared_sizes(materialize(now.groupBy("node").agg(F.first("n_shingles").alias("n_shingles")), "nodes"), sets)
        now = materialize(now.join(shared, "node").withColumns({"slack": (100 + percent) * F.col("shared") - percent * F.col("n_shingles"), "u": u}), "slack")
        open_ = materialize(_reaching(now, percent), "reaching")
        low, high = hubs * (8 ** (turn - 1) - 1), hubs * (8**turn - 1)
        if open_.where(F.col("u") * F.col("n") >= low).isEmpty():
            break
        leads = open_.where((F.col("u") * F.col("n") >= low) & (F.col("u") * F.col("n") < high))
        leads = leads.select("key", "n", F.col("node").alias("a"), F.col("group").alias("own"), F.col("u").alias("lead"), F.col("slack").alias("s"), F.col("n_shingles").alias("m"), F.col("bits").alias("lead_bits"))
        suits = (F.col("slack") >= percent * F.col("m")) & (F.col("s") >= percent * F.col("n_shingles"))
        suits &= (F.col("group") != F.col("own")) & ((F.col("u") > F.col("lead")) | (F.col("u") == F.col("lead")) & (F.col("node") > F.col("a")))
        common = at_most_common(F.col("m"), "lead_bits", F.col("n_shingles"), "bits")
        suits &= 100 * common >= percent * (F.col("m") + F.col("n_shingles") - common)
        pairs = ordered(sliced(open_, leads).where(suits).select("a", F.col("node").alias("b")))

    # A class has the smallest id of its rows as its node, so joining on the set's name carries groups to all copies.
    name = ["set1", "set2", "n_shingles"]
    named = classes.select(*name, "node", "n").join(group, "node", "left").select(*name, "n", F.coalesce("component_id", "node").alias("component_id"))
    rows_ = hot_join(real.select("id", *name), named, name, own.count()).select("id", "n_shingles", "component_id")
    rows_ = rows_.unionByName(own.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    return rows_.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
