"""Packing and byte-level BPE against the tokenizers themselves."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from shelfline.llm import byte_bpe, packing
from shelfline.llm.tokens import ByteEncoder, WordEncoder

DOCS = "doc_id long, text string, lang string, length long, offset string"
ALPHABETS = ["ab \n", "a", "aab'", "éa ñ ", "0123 9", "!-*= ", "中文字日 の", "\U0001f600\U0001f1e9́e‍", "\x00\x1c\x85\xa0  a\t", "st'srel ", "AÀß'sÉ́ Σς"]


def texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(a) for _ in range(r.randint(0, 40))) for a in (r.choice(ALPHABETS) for _ in range(n))]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_encoder_equals_tiktoken(tiktoken_encoding):
    own = ByteEncoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for t in texts(4000, 1):
        assert own.encode(t) == ",".join(map(str, tiktoken_encoding.encode_ordinary(t))), repr(t)


def test_word_encoder_equals_tokenizer():
    own = WordEncoder(P.path("word_bpe_49k.json"))
    for t in [*texts(3000, 2), "<|endoftext|> x", "It's the-end."]:
        assert own.encode(t) == np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_encode_decode_and_offsets(spark, tiktoken_encoding):
    rows = [(1, "Ein Satz.", "de", 0, ""), (2, None, None, None, None), (3, "", "x", 1, "y"), (None, "\U0001f600 é", "e", 2, ""), (5, "a" * 50_000, "en", 3, ""), (5, "a" * 50_000, "en", 3, "")]
    docs = spark.createDataFrame(rows, DOCS)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(docs, path, P.PATTERN, offsets=True)
    got = {(r["doc_id"], len(r["ids"])): r for r in encoded.collect()}
    assert set(got) == {(i, len(tiktoken_encoding.encode_ordinary(t or ""))) for i, t, *_ in rows}
    split = next(r for r in got.values() if r["doc_id"] is None)
    pieces = [tiktoken_encoding.decode_single_token_bytes(i) for i in split["ids"]]
    assert split["offsets"][0]["first"] == 0 and split["offsets"][-1]["last"] == 3 and b"".join(pieces).decode() == "\U0001f600 é"
    back = byte_bpe.decode(encoded, path, P.PATTERN).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t, *_ in rows)
    digests = byte_bpe.digest(docs, path, P.PATTERN).collect()
    for r, (_, t, *_) in zip(digests, rows, strict=True):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.digest(docs.limit(0), path, P.PATTERN).count() == 0


def test_packing_keeps_each_token_once(spark, sf_dir):
    path = P.path("word_bpe_49k.json")
    edge = spark.createDataFrame([(None, "null id", "x", 1, ""), (-7, None, "x", 1, ""), (-8, "", "x", 1, ""), (-9, "word " * 9000, "x", 1, ""), (-10, "same", "", 0, ""), (-10, "same", "", 0, "")], DOCS)
    docs = edge.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"), allowMissingColumns=True)
    own = WordEncoder(path)
    expected: dict = {}
    for r in docs.collect():
        expected.setdefault(r["doc_id"], []).append(own.encode(r["text"] or "") + np.array([1], "<u4").tobytes())
    rows = packing.pack(docs, path, group_docs=64, with_ids=True).collect()
    pieces: dict = {}
    sequences: dict = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["length"] > 0
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc, wanted in expected.items():
        own_pieces = sorted(pieces[doc], key=lambda r: r["start"])
        if len(wanted) == 1:
            assert b"".join(r["ids"] for r in own_pieces) == wanted[0]
            assert {r["doc_tokens"] for r in own_pieces} == {len(wanted[0]) // 4}
        else:
            assert sum(r["length"] for r in own_pieces) == sum(len(w) // 4 for w in wanted)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY and all(r["sequence_tokens"] == at and r["padding"] == packing.padded(at) - at for r in parts)
    tokens = sum(r["length"] for r in rows)
    assert sum(packing.padded(parts[0]["sequence_tokens"]) for parts in sequences.values()) < 1.1 * tokens
    assert packing.pack(docs.limit(0), path).count() == 0


def test_assignment_balances_cost():
    lengths = np.sort(np.random.default_rng(3).integers(1, 2048, 600))[::-1]
    pieces = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    cost: dict = {}
    for _, _, n, k, _ in pieces:
        cost[k] = cost.get(k, 0) + n + n * n / 2048
    assert sum(n for _, _, n, _, _ in pieces) == lengths.sum() and len(cost) == -(-lengths.sum() // 2048)
    assert np.std(list(cost.values())) < 0.25 * np.mean(list(cost.values()))
