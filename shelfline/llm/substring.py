"""Exact substring dedup over words with difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document. A word is removed if it lies in a window whose word sequence
also starts in a document with a smaller id. Every repeated window is found:

1. Documents are cut into chunks of some MB of text, stored once, zstd-compressed, in the shared folder.
2. Anchors: at the positions p with p mod ``PERIOD`` in a difference cover, runs of WINDOW - PERIOD + 1 words are
   hashed. Of two equal windows at any offsets, some anchor lies in both at the same place, so it has the same hash.
   Chunks ask hash buckets which of their distinct anchors another document has; the answer is a bit for each.
3. Extension: only windows around a shared anchor are hashed whole (96 bits) and sent to their buckets, each with the
   smallest document of the chunk; the answer is whether another chunk has a smaller one.
4. The chunks mark the covered words.

A chunk sends each distinct hash once, so a passage that a third of all documents hold costs a bucket one entry a
chunk. Nothing is sent for text that has no shared anchor, and the buckets' number follows the size of the corpus.

Windows are told apart by 96 bits of a hash over 64-bit hashes of their words, the words themselves are not compared: of
n distinct windows some two of different documents are taken for one with a chance below n^2 / 2^97 for the windows and
(words)^2 / 2^65 for the words, which for a trillion windows of a billion
distinct words is 6 in a million and 3 in 100.

Nulls: a null text has no words; a null id counts as larger than any other. Rows with equal ids don't remove each
other's words, and of a passage that several documents hold the smallest id keeps it, so repeated rows and ties don't
depend on their order. Shorter documents than a window keep all words. A text is taken whole: one longer than a chunk is
a chunk of its own. Carried columns may have any names but those of the result. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from shelfline.llm.common import NULL_ID, U64, materialize, narrow_batches, text_words, tidy, window_hashes

WINDOW = 13
#: A perfect difference set: each residue mod 7 is a difference of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
CHUNK_BYTES, BUCKET_ENTRIES = 2 << 20, 4_000_000
BITS = "chunk long, bucket int, bits binary"
WORD_WITH_SPACE = re.compile("[\x09-\x0d\x20]*[^\x09-\x0d\x20]+")


def chunks(docs: DataFrame, id_col: str, text_col: str, carry: list[str], chunk_bytes: int) -> DataFrame:
    """``(chunk, size, payload)``: runs of rows as compressed Arrow streams, the id first and the text second."""
    chosen = narrow_batches(docs).select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col), *carry)
    schema = to_arrow_schema(chosen.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32

        def stored(n: int, parts: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(parts).cast(schema))
            return pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "size", "payload"])

        n, open_, held = 0, [], 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            piece = (held + np.cumsum(sizes)) // chunk_bytes
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    open_.append(batch.slice(a, b - a))
                    held += int(sizes[a:b].sum())
                if open_ and held >= chunk_bytes or b < len(sizes):
                    yield stored(n, open_, held)
                    n, open_, held = n + 1, [], 0
        if open_:
            yield stored(n, open_, held)

    return chosen.mapInArrow(tidy(run), "chunk long, size long, payload binary")


class Chunk:
    """The words of a chunk's documents in a row, as hashes."""

    def __init__(self, payload: bytes) -> None:
        with pa.ipc.open_stream(payload) as stream:
            self.table = stream.read_all()
        ids = self.table.column(0).to_pylist()
        self.texts = [t or "" for t in self.table.column(1).to_pylist()]
        self.h, self.counts = text_words(self.texts)
        self.ids = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        self.doc = np.repeat(np.arange(len(ids)), self.counts)
        starts = np.cumsum(self.counts) - self.counts
        self.place = np.arange(len(self.h)) - starts[self.doc]
        self.left = self.counts[self.doc] - self.place  # words from here to the document's end

    def anchors(self, window: int, buckets: int):
        """Positions of the anchors, their hashes, and the buckets these go to."""
        width = window - PERIOD + 1
        h = window_hashes(self.h, width, 1)
        at = np.flatnonzero(np.isin(self.place[: len(h)] % PERIOD, COVER) & (self.left[: len(h)] >= width) & (self.counts[self.doc[: len(h)]] >= window))
        return at, h[at], ((h[at] >> U64(32)) % U64(buckets)).astype(np.int32)

    def windows(self, window: int, shared_at: np.ndarray, buckets: int):
        """Starts of the windows that hold a shared anchor, both their hashes, and their buckets."""
        n = len(self.h) - window + 1
        if n <= 0 or not len(shared_at):
            none = np.empty(0, np.int64)
            return none, none.astype(U64), none.astype(np.uint32), none.astype(np.int32)
        marks = np.zeros(len(self.h) + 1, np.int64)
        marks[shared_at + 1] = 1
        seen = np.cumsum(marks)
        start = np.arange(n)
        at = np.flatnonzero((seen[start + PERIOD] > seen[start]) & (self.left[:n] >= window))
        h1, h2 = window_hashes(self.h, window, 2)[at], (window_hashes(self.h, window, 3)[at] >> U64(32)).astype(np.uint32)
        return at, h1, h2, ((h1 >> U64(32)) % U64(buckets)).astype(np.int32)


def grouped(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of the keys (the last counts most), where each distinct key begins, and each row's distinct key."""
    order = np.lexsort(keys)
    if not len(order):
        return order, order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), inverse


def six_bytes(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def read_bits(answers: list[dict] | None) -> dict[int, np.ndarray]:
    return {a["bucket"]: np.unpackbits(np.frombuffer(a["bits"], np.uint8)) for a in answers or ()}


def _anchor_groups(chunk: Chunk, window: int, buckets: int):
    """Distinct anchors by bucket: positions, each one's distinct key, and by key its bucket, hash and whether two documents hold it."""
    at, h, bucket = chunk.anchors(window, buckets)
    h = h & U64((1 << 48) - 1)
    order, first, key = grouped((h, bucket))
    doc = chunk.ids[chunk.doc[at]][order]
    many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.empty(0, bool)
    return at, key, bucket[order][first] if len(first) else bucket, h[order][first] if len(first) else h, many


def _shared_at(chunk: Chunk, window: int, buckets: int, answers: list[dict] | None) -> np.ndarray:
    at, key, bucket, _, many = _anchor_groups(chunk, window, buckets)
    return at[(many | _by_bucket(bucket, read_bits(answers)))[key]] if len(at) else at


def _by_bucket(bucket: np.ndarray, bits: dict[int, np.ndarray]) -> np.ndarray:
    """The answers' bits in the order of keys that are sorted by bucket."""
    out = np.zeros(len(bucket), bool)
    names, first, count = np.unique(bucket, return_index=True, return_counts=True)
    for b, a, n in zip(names.tolist(), first.tolist(), count.tolist(), strict=True):
        if b in bits:
            out[a : a + n] = bits[b][:n]
    return out


def _window_groups(chunk: Chunk, window: int, shared_at: np.ndarray, buckets: int):
    at, h1, h2, bucket = chunk.windows(window, shared_at, buckets)
    order, first, key = grouped((h2, h1, bucket))
    doc = chunk.ids[chunk.doc[at]]
    low = np.minimum.reduceat(doc[order], first) if len(first) else np.empty(0, np.int64)
    lead = order[first] if len(first) else order
    return at, doc, key, bucket[lead], h1[lead], h2[lead], low


def _per_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    names, first, count = np.unique(bucket, return_index=True, return_counts=True)
    for b, a, n in zip(names.tolist(), first.tolist(), count.tolist(), strict=True):
        yield b, slice(a, a + n)


def _answer(table: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    keep = [i for i, b in enumerate(bits) if b.any()]
    return pa.table({"chunk": table["chunk"].take(pa.array(keep, pa.int64())), "bucket": table["bucket"].take(pa.array(keep, pa.int64())), "bits": pa.array([np.packbits(bits[i]).tobytes() for i in keep], pa.binary())})


def _blobs(table: pa.Table, column: str) -> list[bytes]:
    return [x.as_py() for x in table[column]]


def match_anchors(table: pa.Table) -> pa.Table:
    """A bucket's answer: of each chunk's anchors, those that another chunk or another document has."""
    raw = [np.frombuffer(b, np.uint8).reshape(-1, 6) for b in _blobs(table, "hashes")]
    sizes = [len(r) for r in raw]
    h = np.zeros((sum(sizes), 8), np.uint8)
    h[:, :6] = np.concatenate(raw)
    many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(_blobs(table, "extra"), sizes, strict=True)]).astype(bool)
    order, first, key = grouped((h.view("<u8").ravel(),))
    count = np.diff([*first, len(order)])
    hit = ((count > 1) | np.logical_or.reduceat(many[order], first))[key]
    return _answer(table, np.split(hit, np.cumsum(sizes)[:-1]))


def match_windows(table: pa.Table) -> pa.Table:
    """A bucket's answer: of each chunk's windows, those that start in a smaller document elsewhere."""
    raw = [np.frombuffer(b, np.dtype([("h1", "<u8"), ("h2", "<u4")])) for b in _blobs(table, "hashes")]
    sizes = [len(r) for r in raw]
    rows, low = np.concatenate(raw), np.concatenate([unpack_ids(b, n) for b, n in zip(_blobs(table, "extra"), sizes, strict=True)])
    order, first, key = grouped((rows["h2"], rows["h1"]))
    hit = np.minimum.reduceat(low[order], first)[key] < low
    return _answer(table, np.split(hit, np.cumsum(sizes)[:-1]))


def pack_ids(ids: np.ndarray) -> bytes:
    base = int(ids.min())
    wide = int(ids.max()) - base >= 1 << 32
    return np.array([base], "<i8").tobytes() + (ids - base if not wide else ids).astype("<i8" if wide else "<u4").tobytes()


def unpack_ids(data: bytes, n: int) -> np.ndarray:
    base = np.frombuffer(data[:8], "<i8")[0]
    if len(data) == 8 + 8 * n:
        return np.frombuffer(data[8:], "<i8")
    return np.frombuffer(data[8:], "<u4").astype(np.int64) + base


ASK = "chunk long, bucket int, hashes binary, extra binary"
_ASK_TYPES = (pa.int64(), pa.int32(), pa.binary(), pa.binary())


def _ask(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ASK_TYPES, strict=True)], names=[f.split()[0] for f in ASK.split(", ")])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row a document: ``carry`` columns, id, what is left of the text, n_words, n_removed and the SHA-256 of the kept words joined by one space.

    The text that is left keeps the white space before each kept word; untouched texts stay as they are."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    carry = [c for c in carry if c not in (id_col, text_col)]
    stored = materialize(chunks(docs, id_col, text_col, carry, chunk_bytes), "chunks")
    size = stored.agg(F.sum("size")).first()[0] or 0
    buckets = max(32, -(-(size // 5 * len(COVER) // PERIOD) // bucket_entries))

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, bucket, h, many = _anchor_groups(Chunk(payload.as_py()), window, buckets)
                h = six_bytes(h)
                yield from _ask([(chunk_id, b, h[s].tobytes(), np.packbits(many[s]).tobytes()) for b, s in _per_bucket(bucket)])

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, payload, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                chunk = Chunk(payload.as_py())
                _, _, _, bucket, h1, h2, low = _window_groups(chunk, window, _shared_at(chunk, window, buckets, answers), buckets)
                rows = np.empty(len(h1), np.dtype([("h1", "<u8"), ("h2", "<u4")]))
                rows["h1"], rows["h2"] = h1, h2
                yield from _ask([(chunk_id, b, rows[s].tobytes(), pack_ids(low[s])) for b, s in _per_bucket(bucket)])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, anchors, answers in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                chunk = Chunk(payload.as_py())
                at, doc, key, bucket, _, _, low = _window_groups(chunk, window, _shared_at(chunk, window, buckets, anchors), buckets)
                gone = np.zeros(len(chunk.h) + 1, np.int64)
                if len(at):
                    hit = at[_by_bucket(bucket, read_bits(answers))[key] | (low[key] < doc)]
                    gone[hit] += 1
                    np.subtract.at(gone, hit + window, 1)
                kept = np.split(np.cumsum(gone[:-1]) == 0, np.cumsum(chunk.counts)[:-1]) if len(chunk.counts) else []
                texts, shas, removed = [], [], []
                for text, keep in zip(chunk.texts, kept, strict=True):
                    words = text.encode().split()
                    lost = len(words) - int(keep.sum())
                    left = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if lost else words
                    shas.append(hashlib.sha256(b" ".join(left)).hexdigest())
                    texts.append("".join([w for w, k in zip(WORD_WITH_SPACE.findall(text), keep.tolist(), strict=True) if k]) if lost else text)
                    removed.append(lost)
                table = chunk.table
                cols = [*(table.column(i).combine_chunks() for i in range(2, table.num_columns)), table.column(0).combine_chunks(), pa.array(texts, pa.string()), pa.array(chunk.counts), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
                yield from pa.table(cols, names=[*carry, id_col, text_col, "n_words", "n_removed", "kept_sha256"]).to_batches()

    def by_chunk(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    anchors = materialize(stored.select("chunk", "payload").mapInArrow(tidy(ask_anchors), ASK).groupBy("bucket").applyInArrow(match_anchors, BITS), "anchors")
    with_anchors = stored.join(by_chunk(anchors, "anchors"), "chunk", "left").select("chunk", "payload", "anchors")
    windows = materialize(with_anchors.mapInArrow(tidy(ask_windows), ASK).groupBy("bucket").applyInArrow(match_windows, BITS), "windows")
    result = stored.join(by_chunk(anchors, "anchors"), "chunk", "left").join(by_chunk(windows, "windows"), "chunk", "left").select("payload", "anchors", "windows")
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carry), f"`{id_col}` long, `{text_col}` string, n_words long, n_removed long, kept_sha256 string"])
    return result.mapInArrow(tidy(mark), schema)
