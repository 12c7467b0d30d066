"""Classifier, language identification, tool calls and the pipeline."""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shelfline.llm import common, language, quality, registry, tool_calls
from tests.compare import connection, same

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, con, name):
    same(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name])


def test_quality_held_out(spark):
    rows = registry.op10_positive_unlabelled_quality(spark, LARGER).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    known = [(labels[r["doc_id"]], r["predicted"]) for r in held if r["doc_id"] in labels]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)


def test_quality_edges(spark):
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "some text", "s"), (4, "word " * 30_000, "s"), (4, "word " * 30_000, "s")], schema)
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 1, 0), (4, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = quality.classify(docs, known).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_risk_and_its_direction():
    """The risk as its formula says, and its gradient by differences; below zero the part of negatives is turned round."""
    rng = np.random.default_rng(3)
    loss = lambda g: math.log1p(math.exp(-g))
    for shift, below in ((0.0, False), (-6.0, True)):
        g, n_p, prior = rng.normal(size=12), 5, 0.7
        g[n_p:] += shift
        rest = sum(loss(-x) for x in g[n_p:]) / 7 - prior * sum(loss(-x) for x in g[:n_p]) / n_p
        assert (rest < 0) == below
        value, dg = quality.non_negative_risk(g, n_p, prior)
        assert abs(value - (prior * sum(map(loss, g[:n_p])) / n_p + max(0.0, rest))) < 1e-12

        def part(x, below=below, n_p=n_p, prior=prior):
            neg = np.logaddexp(0, x)[n_p:].mean() - prior * np.logaddexp(0, x)[:n_p].mean()
            return -neg if below else prior * np.logaddexp(0, -x[:n_p]).mean() + neg

        for k in range(12):
            step = np.zeros(12)
            step[k] = 1e-6
            assert abs((part(g + step) - part(g - step)) / 2e-6 - dg[k]) < 1e-8


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled(prior):
    """No negative label is seen: the prior comes from two samples alone."""
    rng = np.random.default_rng(int(10 * prior))
    good = lambda n: rng.normal(2.0, 1, (n, 6))
    bad = lambda n: rng.normal(-1.0, 1, (n, 6))
    k = int(3000 * prior)
    mixed = rng.permutation(np.concatenate([good(k), bad(3000 - k)]))
    assert abs(quality.estimate_prior(good(2000), mixed) - prior) < 0.05


def test_very_long_texts_in_blocks(monkeypatch):
    """Features, n-grams and shingles of one long text are the same in blocks, and a batch is cut by bytes."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}, Än\n" for x in rng.integers(0, 900, 20_000)), "", None, "short one", "x"]
    whole = quality.features(texts)
    monkeypatch.setattr(quality, "_BLOCK", 1000)
    assert np.array_equal(quality.features(texts), whole)
    alone = np.concatenate([quality.features([t]) for t in texts])
    assert np.allclose(alone, whole)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = list(common.slices(batch, 0, rows=2, size=100))
    assert [p.num_rows for p in parts] == [1, 2, 2] and [x for p in parts for x in p.column(0).to_pylist()] == texts
    counts = common.text_words(texts)[1].tolist()
    assert counts == [len((t or "").split()) for t in texts]


def brute_mixture(grams, table, steps, penalty):
    """The same inference for one document, in plain Python."""
    langs, total = table.shape[1], sum(n for _, n in grams)

    def fit(chosen):
        share = [1 / len(chosen) if k in chosen else 0.0 for k in range(langs)]
        for _ in range(steps if len(chosen) > 1 else 0):
            new = [0.0] * langs
            for code, n in grams:
                mixed = sum(share[k] * table[code, k] for k in chosen)
                for k in chosen:
                    new[k] += n * share[k] * table[code, k] / mixed
            share = [x / total for x in new]
        return share, sum(n * math.log(sum(share[k] * table[code, k] for k in chosen)) for code, n in grams)

    every, value = fit(range(langs))
    order = sorted(range(langs), key=lambda k: (-every[k], k))
    options = [(every, -2 * value + penalty * (langs - 1) * math.log(max(total, 2)))]
    for size in range(langs - 1, 0, -1):
        share, value = fit(sorted(order[:size]))
        options.append((share, -2 * value + penalty * (size - 1) * math.log(max(total, 2))))
    best = options[0]
    for o in options[1:]:
        best = o if o[1] <= best[1] else best
    return best[0]


def test_inference_against_brute_force():
    rng = np.random.default_rng(2)
    table = rng.dirichlet(np.full(200, 0.3), size=3).T + 1e-6
    doc, code, count, grams = [], [], [], []
    for i in range(40):
        own = rng.dirichlet(np.full(3, 0.4))
        drawn, n = np.unique(rng.choice(200, size=int(rng.integers(20, 900)), p=(table @ own) / (table @ own).sum()), return_counts=True)
        grams.append(list(zip(drawn.tolist(), n.tolist(), strict=True)))
        doc += [i] * len(drawn)
        code += drawn.tolist()
        count += n.tolist()
    got = language.infer(np.array(doc), table[code], np.array(count, float), 40, steps=12, penalty=5.0)
    want = np.array([brute_mixture(g, table, 12, 5.0) for g in grams])
    assert np.allclose(got, want, atol=1e-9)
    assert 1 in (want > 0).sum(1) and 2 in (want > 0).sum(1)


def test_languages_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text of some words {i}", f"l{i % 9}") for i in range(90)] + [(100 + i, "more words", "l0") for i in range(20)], "doc_id long, text string, lang string")
    langs, table = language.learn(docs, languages=3)
    assert langs == ["l0", "l1", "l2"] and table.shape[1] == 3


def test_labels_of_held_out_rows_are_not_learned(spark, sf_dir):
    """Changing held-out labels, or langs, changes nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    score = lambda x: sorted((r["doc_id"], round(r["score"], 9)) for r in quality.classify(docs, x).collect())
    assert score(labels) == score(other)
    changed = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 'zz' else lang end as lang")
    pred = lambda x: sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(x, language.learn(x)).collect())
    assert pred(docs) == pred(changed)


def test_language(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = {r["doc_id"]: r for r in registry.op9_mixture_language_id(spark, LARGER).collect()}
    held = [(r["lang"], rows[r["doc_id"]]) for r in docs.collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(lang == r["lang_pred"] for lang, r in held) >= 0.98 * len(held)
    model = language.learn(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) between 2000 and 3000").collect()}
    mixed = spark.createDataFrame([(1, texts["en"] + "\n" + texts["de"]), (2, None), (3, ""), (4, "123 !!"), (None, texts["fr"]), (6, texts["es"]), (6, texts["es"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(mixed, model).collect()}
    assert set(got[1]["languages"]) == {"en", "de"} and abs(sum(got[1]["languages"].values()) - 1) < 1e-9
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4))
    assert got[None]["lang_pred"] == "fr" and got[6]["lang_pred"] == "es"
    none = docs.limit(0)
    assert language.identify(mixed, language.learn(none)).where("lang_pred <> 'und'").count() == 0
    assert language.identify(none, model).count() == 0


CALLS = "conv long, call_id string, place long, name string, arguments string, uses array<string>, level string"
RESULTS = "conv long, call_id string, place long, content string, status string"
SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "number", "minimum": 0}, "b": {"type": ["integer", "null"]}, "c": {"type": "array", "items": {"enum": ["x", "y"]}}}}}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "c1", 4, "add", '{"b": 2, "a": 1.5}', ["c2"], ""),
            (1, "c2", 6, "add", '{"a": 1, "c": ["x", "z"]}', [], ""),
            (1, "c2", 7, "add", '{"a": 9}', None, ""),
            (1, "c3", 8, "none", "{}", ["lost"], ""),
            (2, "c1", 1, "add", "[1]", None, ""),
            (3, "p", 1, "add", '{"a": 0}', ["q"], ""),
            (3, "q", 2, "add", None, ["p"], ""),
            (3, "r", 3, "add", '{"a": 0}', ["q"], ""),
            (None, "c1", 1, "add", '{"a": "é", "z": 0}', None, ""),
            (5, None, 1, "add", '{"a": true}', None, ""),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, "c1", 9, "late", ""), (1, "c1", 5, "é", ""), (1, "c9", 5, "who", ""), (4, "c1", 1, None, "")], RESULTS)
    rows = {(r["conv"], r["call_id"], r["place"]): r for r in tool_calls.link(calls, results, SCHEMAS).collect()}
    assert len(rows) == 12
    one = rows[1, "c1", 4]
    assert (one["status"], one["level"], one["valid"]) == ("linked", 1, True)
    assert one["json"] == '{"arguments":{"a":1.5,"b":2},"id":"c1","name":"add","result":"é","uses":["c2"]}'
    assert rows[1, "c2", 6]["level"] == 0 and rows[1, "c2", 6]["errors"] == ["$.c[1]: not in enum"] and rows[1, "c2", 7]["status"] == "repeated"
    assert rows[1, "c3", 8]["errors"] == ["uses unknown call lost", "unknown tool none"]
    assert rows[2, "c1", 1]["errors"] == ["arguments are no JSON object"]
    assert [rows[3, x, n]["level"] for n, x in enumerate("pqr", 1)] == [-1, -1, -1] and rows[3, "q", 2]["errors"] == ["calls wait for each other", "$: a is missing"]
    assert rows[None, "c1", 1]["errors"] == ["$.a: not of type number", "$: z is unknown"] and rows[5, None, 1]["errors"] == ["$.a: not of type number"]
    assert {k for k, r in rows.items() if r["status"] == "orphan"} == {(1, "c9", 5), (4, "c1", 1)}
    for r in rows.values():
        if r["json"]:
            assert tool_calls.canonical(json.loads(r["json"])) == r["json"]
    assert tool_calls.link(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def test_long_chain_of_calls(spark):
    calls = spark.createDataFrame([(1, f"c{i}", 10 - i, "add", '{"a":1}', [f"c{i - 1}"] if i else [], "") for i in range(6)], CALLS)
    got = {r["call_id"]: r["level"] for r in tool_calls.link(calls, spark.createDataFrame([], RESULTS), SCHEMAS).collect()}
    assert got == {f"c{i}": i for i in range(6)}


def test_levels_of_mixed_graphs(spark):
    import random

    r, rows, want = random.Random(8), [], {}
    for conv in range(12):
        names = [f"n{i}" for i in range(25)]
        uses = {n: r.sample(names[:i], min(i, r.choice([0, 1, 1, 1, 2, 3]))) for i, n in enumerate(names)}
        if conv % 3 == 0:
            uses["n5"], uses["n7"] = ["n9"], ["n7"]
        level = {}
        for _ in names:
            level = {n: 1 + max((level[u] for u in us), default=-1) for n, us in uses.items() if all(u in level for u in us)} | level
        want |= {(conv, n): level.get(n, -1) for n in names}
        rows += [(conv, n, [*us, "unknown"]) for n, us in uses.items()]
    rows += [(50, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(70)]
    want |= {(50, f"c{i}"): i for i in range(70)}
    got = {(x["conv"], x["call_id"]): x["level"] for x in tool_calls.levels(spark.createDataFrame(rows, "conv long, call_id string, uses array<string>")).collect()}
    assert got == want
