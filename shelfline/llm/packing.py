"""Cost-balanced packing of documents into token sequences.

A document's attention cost is estimated as ``linear * n + quadratic * n**2``. Full sequences are cut off long
documents first; the rest is dealt to groups by a hash, and in each group the remainders, dearest first, go to the
cheapest sequence that still has room. Where none has room for all of it, a remainder is cut, so a group of T tokens
always fits in ceil(T / capacity) sequences and pads less than one of them.

One pass tokenizes (mapInArrow) and one shuffle carries the remainders' ids, two bytes each where the vocabulary
allows. A group holds a bounded number of documents, so no key is hot: copies of one row are spread by how many came
before in their task, which keeps a number for each row of an input split.

Nulls: a null text is empty and packs as its end token alone; a null doc_id is packed like any other. Repeated rows
are packed each. Remainders of equal length go by id, nulls last, then by their ids, and of equally cheap sequences the
first is taken, so ties don't change the result. Texts are tokenized whole, however long, and only full sequences of them
leave the task before the rest. An empty table gives an empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import narrow_batches, slices, tidy
from shelfline.llm.tokens import WordEncoder, encoder

CAPACITY, END_ID, GROUP_DOCS = 2048, 1, 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long"


def padded(n: int, capacity: int = CAPACITY) -> int:
    """A sequence of n tokens is padded to the capacity, except at a power of two."""
    return n if n and n & (n - 1) == 0 else capacity


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, length, sequence, offset)`` of items given in descending order of cost."""
    count = -(-int(lengths.sum()) // capacity)
    cost, room, out = np.zeros(count), np.full(count, capacity), []
    for item, n in enumerate(lengths.tolist()):
        start = 0
        while n:
            fits = np.where(room >= n, cost, np.inf)
            k = int(fits.argmin())
            if fits[k] == np.inf:  # cut: the sequence with most room takes what it can
                k = int(room.argmax())
            take = min(n, int(room[k]))
            out.append((item, start, take, k, capacity - int(room[k])))
            room[k] -= take
            cost[k] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence, the CRC-32 of its ids and, if asked for, the ids."""
    groups = max(1, -(-docs.count() // group_docs))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(WordEncoder, tokenizer_path)
        narrow = "<u2" if max(encode.tokenizer.get_vocab_size(with_added_tokens=True), end_id) <= 1 << 16 else "<u4"
        end, seen = np.array([end_id], "<u4").tobytes(), {}
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encode.encode(text or "") + end
                total, crc = len(raw) // 4, zlib.crc32(raw)
                # copies of a row differ by how many of them came before, so that they go to different groups
                nth = seen[doc, crc] = seen.get((doc, crc), -1) + 1
                group = zlib.crc32(f"{doc},{crc},{nth}".encode()) % groups
                full = total // capacity if total > capacity else 0
                for k in range(full):
                    ids = raw[4 * capacity * k : 4 * capacity * (k + 1)]
                    rows.append((group, doc, capacity * k, capacity, zlib.crc32(ids), total, ids if with_ids else None))
                if rest := raw[4 * capacity * full :]:
                    rows.append((group, doc, capacity * full, len(rest) // 4, None, total, np.frombuffer(rest, "<u4").astype(narrow).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["group", "doc_id", "start", "length", "crc", "doc_tokens", "ids"])

    def pack_group(table: pa.Table) -> pa.Table:
        group, crc = table["group"][0].as_py(), table["crc"].to_pylist()
        doc, start, length, total, ids = (table[c].to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids"))
        key = lambda i: (-length[i], doc[i] is None, doc[i] or 0, start[i], ids[i] or b"")
        full = sorted((i for i in range(len(doc)) if crc[i] is not None), key=key)
        rest = sorted((i for i in range(len(doc)) if crc[i] is None), key=key)
        first, out = group << 32, []
        for k, i in enumerate(full):
            out.append((doc[i], start[i], length[i], crc[i], total[i], first + k, 0, capacity, 0, ids[i]))
        pieces = assign(np.array([length[i] for i in rest], np.int64), capacity, linear, quadratic)
        used: dict[int, int] = {}
        for _, _, n, k, _ in pieces:
            used[k] = used.get(k, 0) + n
        for item, begin, n, k, offset in pieces:
            i = rest[item]
            width = len(ids[i]) // length[i]
            raw = np.frombuffer(ids[i][begin * width : (begin + n) * width], f"<u{width}").astype("<u4").tobytes()
            out.append((doc[i], start[i] + begin, n, zlib.crc32(raw), total[i], first + len(full) + k, offset, used[k], padded(used[k], capacity) - used[k], raw if with_ids else None))
        names = [*(f.split()[0] for f in SCHEMA.split(", ")), "ids"]
        cols = [pa.array(x, pa.binary() if name == "ids" else pa.int64()) for name, x in zip(names, zip(*out, strict=True), strict=True)]
        table = pa.table(dict(zip(names, cols, strict=True)))
        return table if with_ids else table.drop(["ids"])

    pieces = narrow_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(tokenize, remembers=True), "group long, doc_id long, start long, length long, crc long, doc_tokens long, ids binary")
    return pieces.groupBy("group").applyInArrow(pack_group, SCHEMA + (", ids binary" if with_ids else ""))
