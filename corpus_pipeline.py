"""Corpus pipeline: quality, line dedup, near dedup, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept. All but the last return the
columns of their input; ``run`` writes each stage's rows to the shared folder and reads them again for the next.
Columns beyond id and text travel as one struct, so none can clash with an operator's own.

``n_chars`` follows the text where a stage changes it. A document that loses all its words to a dedup stage goes; one
that had none stays. Rows that share a non-null id and a text are one document, of which the near-dup stage keeps one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import lines, minhash, packing, quality, substring
from shelfline.llm.common import load, materialize
from shelfline.llm.registry import tokenizer_file

#: SQL can't express the classifier or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None
CARRIED = "_carried"
ROW_KEY, FIRST_TEXT = "_row_key", "_first_text"
WORDS = "[^\x09-\x0d\x20]"


def _pack_columns(docs: DataFrame) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias(CARRIED))


def _unpack_columns(out: DataFrame, docs: DataFrame, changed: F.Column | None = None) -> DataFrame:
    kinds = dict(docs.dtypes)

    def column(c: str) -> F.Column:
        if c == "text":
            return F.col("text")
        if c == "doc_id":
            return F.col("doc_id").cast(kinds[c]).alias(c)
        value = F.col(f"{CARRIED}.`{c}`")
        if c == "n_chars" and changed is not None:
            value = F.when(changed, F.length("text").cast(kinds[c])).otherwise(value)
        return value.alias(c)

    return out.select(*map(column, docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    scored = quality.score(_pack_columns(docs), model, carry=("doc_id", "text", CARRIED))
    return _unpack_columns(scored.where(F.col("score") >= quality.THRESHOLD), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line duplicates."""
    out = lines.dedup(_pack_columns(docs), carry=(CARRIED,))
    return _unpack_columns(out.where((F.col("n_removed") == 0) | F.col("text").rlike(WORDS)), docs, F.col("n_removed") > 0)


def _split(rows: DataFrame, few: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among a few, and all others, which then go through no join's shuffle."""
    both = lines.marked(rows, lines.bit_map(few, key), key)
    return both.where("hit").drop("hit"), both.where("not hit").drop("hit")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    A row's key is its id; where an id has several texts, all but one of them, and rows without an id, have a hash of id
    and text from 2^62 on, so they come after all ids below that. Texts without words stay, with null ids each row. Only
    texts of ids with several texts, of documents that go, and of repeated rows are shuffled."""
    own = F.xxhash64("text")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias(FIRST_TEXT), F.max(own).alias("_last"))
    several = materialize(several.where(F.col(FIRST_TEXT) < F.col("_last")).select("doc_id", FIRST_TEXT), "ids-of-several-texts")
    late = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2))
    some, most = _split(docs, several, "doc_id")
    key = F.when(F.col("doc_id").isNull() | (own != F.col(FIRST_TEXT)), late).otherwise(F.col("doc_id").cast("long"))
    keyed = some.join(several, "doc_id", "left").withColumn(ROW_KEY, key).drop(FIRST_TEXT)
    keyed = keyed.unionByName(most.withColumn(ROW_KEY, F.when(F.col("doc_id").isNull(), late).otherwise(F.col("doc_id").cast("long"))))
    empty = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORDS), F.lit(False))
    named = keyed.where(~empty)
    found = minhash.near_duplicates(named, id_col=ROW_KEY).groupBy(ROW_KEY).agg(F.bool_and("kept").alias("_stays"), F.count("*").alias("_rows"))
    touched = materialize(found.where("not _stays or _rows > 1").select(ROW_KEY, "_stays"), "gone-or-repeated")
    maybe, rest = _split(named, touched, ROW_KEY)
    one = maybe.dropDuplicates([ROW_KEY]).join(touched, ROW_KEY, "left").where("_stays is null or _stays").drop("_stays")
    return rest.unionByName(one).unionByName(keyed.where(empty)).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that also start in an earlier document."""
    out = substring.dedup(_pack_columns(docs), carry=(CARRIED,))
    return _unpack_columns(out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))), docs, F.col("n_removed") > 0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
