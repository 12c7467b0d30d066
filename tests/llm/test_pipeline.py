"""The pipeline's stages on a small corpus with planted cases."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark import cloudpickle

import corpus_pipeline as p
from shelfline.llm import common
from shelfline.llm.common import materialize
from tests.llm.test_dedup import brute_lines, brute_near, brute_substring

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in p.STAGES:
        out.append(materialize(stage(spark, out[-1], SMALL), f"test-{name}"))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_and_ids(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
        assert df.where("n_chars <> length(text)").isEmpty()
    packed = {r["doc_id"] for r in stages[-1].collect()}
    assert packed == {i for i, _ in pairs(stages[-2])}


def test_stages_against_brute_force(stages):
    _, good, lined, near, sub, _ = stages
    left = {i: t for i, _, n, t in brute_lines(pairs(good)) if n == 0 or t.split()}
    assert dict(pairs(lined)) == left
    kept = {i for i, _, _, k in brute_near(pairs(lined), 5, 80) if k}
    assert {i for i, _ in pairs(near)} == kept
    words = {i: n - gone for i, n, gone, _ in brute_substring(pairs(near)) if gone == 0 or gone < n}
    assert {i: len((t or "").split()) for i, t in pairs(sub)} == words


def test_quality_stage_keeps_clean_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {i for i, _ in pairs(stages[1])}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_edge_rows(spark):
    r = random.Random(1)
    text = " ".join(f"t{r.randrange(500)}" for _ in range(80))
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, _carry array<int>"
    rows = [(1, text, None, "a", 1, "x", [1]), (2, text, "en", None, None, None, None), (2, text, "en", None, None, None, None), (3, None, "en", "b", 0, "", []), (4, "", "en", "b", 0, "", []), (None, "alone here", "en", "b", 10, "", [])]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in p.STAGES[1:4]:
        docs = materialize(stage(spark, docs, SMALL), f"edge-{name}")
        assert docs.dtypes == spark.createDataFrame([], schema).dtypes
    assert sorted((x["doc_id"] for x in docs.collect()), key=repr) == sorted([1, 3, 4, None], key=repr)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_near_stage_drops_only_near_duplicates(spark):
    r = random.Random(2)
    a, b, c, e = (" ".join(f"t{r.randrange(500)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (None, e), (None, e), (None, a), (None, None), (None, None), (None, " ")]
    out = p.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    got = sorted(pairs(out), key=repr)
    texts = sorted((t for _, t in got if t and t.strip()), key=repr)
    assert texts == sorted([a, b, c, e], key=repr)
    assert [t for i, t in got if i is None and not (t and t.strip())] == [" ", None, None]
    assert (3, c) in got and (None, e) in got


def test_a_worker_keeps_no_encoder_for_other_stages():
    """As a task gets it, pickled: what packing remembers goes when another stage's task begins, and batches stay as they are."""
    batch, same = pa.RecordBatch.from_pydict({"n": [1, 2]}), lambda batches: batches
    sent = lambda **how: cloudpickle.loads(cloudpickle.dumps(common.tidy(same, **how)))
    kept = common.REMEMBERED_BY_WORKER
    kept["packing", "file"] = object()
    assert list(sent(remembers=True)(iter([batch]))) == [batch] and kept
    assert list(sent()(iter([batch]))) == [batch] and not kept
