"""Language identification by mixture inference.

Each language is a distribution over hashed byte n-grams of lower-cased letters. A document is a mixture of
languages: expectation-maximisation estimates its proportions, first over all languages; then the sets of its k most
likely languages are fitted in turn, and the set with the best penalised likelihood stands. The prediction is the
language with the largest proportion in it, its score that proportion.

Documents are inferred side by side, as rows (document, n-gram, count) of a batch; whole texts are read. Learning takes
about ``SAMPLE`` documents a language, chosen by a hash of their ids, of the ``LANGUAGES`` languages that most documents
have; the n-gram counts of these are summed by a grouping, so the driver gets at most one row a language and bucket, and
the table that goes to the tasks has at most BUCKETS x LANGUAGES numbers.

Nulls: a null text or one without a letter is ``und`` with score 0; a null lang is not learned from. Where nothing can
be learned all is ``und``. Of equal proportions the first language by name is predicted, of equally frequent ones at the
bound of ``LANGUAGES`` the first by name is learned. Texts are read whole, in slices of a bounded number of bytes; a
longer text is taken alone. Equal texts have equal results. An empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import U64, crc_mod, mix, narrow_batches, slices

SAMPLE, BUCKETS, STEPS, PENALTY, FOLDS, LANGUAGES = 2000, 1 << 15, 12, 24.0, 3, 128
LETTER = re.compile(r"[^\W\d_]")
#: Letters and bytes beyond ASCII stand for themselves, all else for a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (document, bucket, count) in order of the documents: byte trigrams of the folded texts."""
    raw = [b" " + (t or "").lower().encode() + b" " for t in texts]
    data = _FOLD[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
    doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    keep = (doc[2:] == doc[:-2]) & (code != 0x202020) & ((code & 0xFFFF) != 0x2020)
    code = (mix(code[keep].astype(U64)) % U64(BUCKETS)).astype(np.int64)
    rows, n = np.unique(doc[2:][keep] * BUCKETS + code, return_counts=True)
    return rows // BUCKETS, rows % BUCKETS, n.astype(np.float64)


def infer(doc: np.ndarray, likelihood: np.ndarray, count: np.ndarray, docs: int, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Proportions (docs x languages), zero outside each document's chosen set.

    likelihood has a row of probabilities under each language for each (document, n-gram) row."""
    langs = likelihood.shape[1]
    total = np.bincount(doc, count, docs)

    def fit(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = mask / np.maximum(1, mask.sum(1, keepdims=True))
        for _ in range(steps if mask.sum(1).max() > 1 else 0):
            part = share[doc] * likelihood
            part *= (count / part.sum(1))[:, None]
            share = np.stack([np.bincount(doc, part[:, k], docs) for k in range(langs)], 1) / np.maximum(1e-12, total)[:, None]
        mixed = np.einsum("ij,ij->i", share[doc], likelihood)
        return share, np.bincount(doc, count * np.log(np.maximum(mixed, 1e-300)), docs)

    full, value = fit(np.ones((docs, langs)))
    best, best_cost = full, -2 * value + penalty * (langs - 1) * np.log(np.maximum(total, 2))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    for k in range(langs - 1, 0, -1):
        share, value = fit((rank < k).astype(np.float64))
        cost = -2 * value + penalty * (k - 1) * np.log(np.maximum(total, 2))
        better = cost <= best_cost
        best, best_cost = np.where(better[:, None], share, best), np.where(better, cost, best_cost)
    return best


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, folds: int = FOLDS, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The languages, in order, and the probability of each bucket (buckets x languages) under each."""
    rows = narrow_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, folds) != 1)).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.empty((BUCKETS, 0))
    one = 1 << 30
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, sample / sizes[lang]) * one))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(5), F.coalesce("id", F.lit(0))), F.lit(one)) < share[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: k for k, lang in enumerate(langs)}
        sums = np.zeros((len(langs), BUCKETS))
        for batch in batches:
            for part in slices(batch, 1):
                own = np.array([place[x] for x in part.column(0).to_pylist()])
                doc, code, n = gram_counts(part.column(1).to_pylist())
                np.add.at(sums, (own[doc], code), n)
        k, code = np.nonzero(sums)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(code), pa.array(sums[k, code])], names=["k", "code", "n"])

    got = chosen.mapInArrow(run, "k long, code long, n double").groupBy("k", "code").agg(F.sum("n").alias("n")).toArrow()
    sums = np.full((BUCKETS, len(langs)), 0.5)
    sums[np.array(got["code"].to_pylist(), int), np.array(got["k"].to_pylist(), int)] += np.array(got["n"].to_pylist(), float)
    return langs, sums / sums.sum(0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """``(id, lang_pred, score, languages map<string,double>, held_out)``; languages holds the chosen set's proportions."""
    langs, table = model
    table = table.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 128):
                texts = batch.column(1).to_pylist()
                spoken = [bool(langs) and t is not None and LETTER.search(t) is not None for t in texts]
                doc, code, n = gram_counts([t if s else "" for t, s in zip(texts, spoken, strict=True)])
                share = infer(doc, table[code].astype(np.float64), n, len(texts)) if langs else np.zeros((len(texts), 1))
                best = share.argmax(1).tolist()
                pred = [langs[k] if s else "und" for k, s in zip(best, spoken, strict=True)]
                score = [min(1.0, float(share[i, k])) if s else 0.0 for i, (k, s) in enumerate(zip(best, spoken, strict=True))]
                sets = [[(langs[k], float(p)) for k, p in enumerate(row) if p > 0] if s else [] for row, s in zip(share.tolist(), spoken, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], names=[id_col, "lang_pred", "score", "languages"])

    chosen = narrow_batches(docs).select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"`{id_col}` long, lang_pred string, score double, languages map<string,double>").withColumn("held_out", crc_mod(id_col, folds) == 1)
