"""Byte-level BPE encoding and decoding over Arrow batches.

The ranks become a merge table of the tokenizers library: each byte stands as a printable character, and every way of
splitting a token into two known ones is a merge at the token's place. Decoding reverses the byte table; a character
that is split between tokens is whole again once their bytes are joined, and its tokens' character offsets overlap.

Nulls: a null text is empty and has no ids. Texts are encoded whole; a task holds a slice of a bounded number of bytes,
or one longer text, at a time. Repeated rows give repeated results, so there are no ties to break; an empty table gives
an empty one.
Other columns are kept out of the way: the result has the id column and the operator's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import narrow_batches, slices
from shelfline.llm.tokens import ByteEncoder, encoder


def char_offsets(pieces: list[bytes]) -> list[tuple[int, int]]:
    """First and last (exclusive) character that each piece touches; pieces of one split character share it."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    chars = np.cumsum((data & 0xC0) != 0x80)  # the character that a byte belongs to, from 1
    ends = np.cumsum([len(p) for p in pieces])
    return [(int(chars[e - len(p)]) - 1, int(chars[e - 1])) for p, e in zip(pieces, ends, strict=True)]


def _int_ids(text: str) -> list[int]:
    return list(map(int, text.split(","))) if text else []


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``(id, ids array<int>[, offsets array<struct<first,last>>])`` of each whole text."""
    schema = f"{id_col} long, ids array<int>" + (", offsets array<struct<first:int,last:int>>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ByteEncoder, ranks_path, pattern)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids = [_int_ids(own.encode(t or "")) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                spans = [[{"first": a, "last": b} for a, b in char_offsets(own.pieces(x))] for x in ids]
                cols.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", "offsets"][: len(cols)])

    return narrow_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, data binary, text)``: the bytes of the ids, and their text (null where they are no UTF-8, or the ids null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ByteEncoder, ranks_path, pattern)
        for batch in batches:
            data = [None if ids is None else b"".join(own.pieces(ids)) for ids in batch.column(1).to_pylist()]
            text = []
            for x in data:
                try:
                    text.append(None if x is None else x.decode())
                except UnicodeDecodeError:
                    text.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(text, pa.string())], names=[id_col, "data", "text"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"{id_col} long, data binary, text string")


def digest(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, keeping only digests: ``(id, n_tokens, ids_sha256, decoded_sha256)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ByteEncoder, ranks_path, pattern)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                numbers = _int_ids(ids)
                rows.append((len(numbers), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join(own.pieces(numbers))).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
