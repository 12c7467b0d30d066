"""Substring, line and near dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from shelfline.llm import common, lines, minhash, substring

DOCS = "doc_id long, text string, n_words long, kept boolean, component_id string, bits binary"
WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, None, "x", b"") for i, t in rows], DOCS)


def corpus(seed: int, n: int = 60, words: int = 40, lexicon: int = 400):
    """Random texts with shared passages, copies and near copies, nulls, empty texts and repeated rows."""
    r = random.Random(seed)
    lex = [f"w{i}" for i in range(lexicon)] + ["É", "ß,", "x y"]
    passage = [r.choice(lex) for _ in range(30)]
    rows = []
    for i in range(n):
        ws = [r.choice(lex) for _ in range(r.randint(0, words))]
        kind = r.random()
        if kind < 0.3:
            at, k = r.randint(0, len(ws)), r.randint(8, 30)
            ws[at:at] = passage[:k]
        elif kind < 0.6 and rows:
            ws = (r.choice(rows)[1] or "").split()
            for _ in range(r.randint(0, 3)):
                if ws:
                    ws[r.randrange(len(ws))] = r.choice(lex)
        seps = [" ", " ", " ", "\n", "\t", "  "]
        rows.append((i * 3 + 1, "".join(w + r.choice(seps) for w in ws)))
    rows += [(2, None), (5, ""), (8, " \n "), (rows[4][0], rows[4][1]), (None, rows[6][1]), (1000, "le " * 300), (1001, "LE " * 280)]
    r.shuffle(rows)
    return rows


def brute_substring(rows, window=13):
    first: dict = {}
    inf = 1 << 63
    for i, t in rows:
        ws = WORD.findall(t or "")
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            first[key] = min(first.get(key, inf), inf if i is None else i)
    out = []
    for i, t in rows:
        ws = WORD.findall(t or "")
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < (inf if i is None else i):
                gone |= set(range(k, k + window))
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    out = substring.dedup(frame(spark, rows).repartition(3), chunk_bytes=500, bucket_entries=300, carry=("component_id",)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out), key=repr) == brute_substring(rows)
    for r in out:
        assert hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest() == r["kept_sha256"]
        assert r["component_id"] == "x"
    assert substring.dedup(frame(spark, rows).limit(0)).count() == 0


def distance(a, b):
    """Word edits, exact up to 1."""
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows, min_words=8):
    every = []
    for i, t in rows:
        for k, line in enumerate([] if t is None else t.split("\n")):
            if ws := WORD.findall(line):
                every.append(((1 << 63 if i is None else i), k, ws))
    out = []
    for i, t in rows:
        parts = [] if t is None else t.split("\n")
        left, gone = [], 0
        for k, line in enumerate(parts):
            ws, me = WORD.findall(line), (1 << 63 if i is None else i, k)
            hit = ws and any((a, b) < me and (xs == ws or min(len(xs), len(ws)) >= min_words and distance(xs, ws) <= 1) for a, b, xs in every)
            gone += bool(hit)
            if not hit:
                left.append(line)
        out.append((i, len(parts), gone, None if t is None else "\n".join(left)))
    return sorted(out, key=repr)


def line_corpus(seed: int):
    r = random.Random(seed)
    lex = [f"v{i}" for i in range(30)]
    pool = [[r.choice(lex) for _ in range(r.choice([1, 3, 7, 8, 9, 9, 12, 15]))] for _ in range(25)]
    rows = []
    for i in range(30):
        parts = []
        for _ in range(r.randint(0, 6)):
            ws = list(r.choice(pool))
            kind = r.random()
            if kind < 0.25:
                ws[r.randrange(len(ws))] = r.choice(lex)
            elif kind < 0.4:
                ws.insert(r.randint(0, len(ws)), r.choice(lex))
            elif kind < 0.5 and len(ws) > 1:
                del ws[r.randrange(len(ws))]
            parts.append(r.choice([" ", "  ", "\t"]).join(ws))
        rows.append((i * 2 + 1, r.choice(["\n", "\n\n", "\n"]).join(parts)))
    rows += [(4, None), (6, ""), (8, "\n \n"), (None, rows[3][1]), (rows[5][0], rows[5][1]), (2000, " ".join(lex * 200)), (2001, " ".join([*lex * 200, "end"]))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = line_corpus(seed)
    out = lines.dedup(frame(spark, rows), carry=("kept", "n_words")).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in out), key=repr) == brute_lines(rows)
    assert lines.dedup(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_is_native(spark):
    plan = lines.dedup(frame(spark, line_corpus(3)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_variants_of_a_line(spark):
    """The i-th key is the whole hash of the words without the i-th; no two variants of other words share one."""
    r = random.Random(8)
    pool = [[f"w{r.randrange(5)}" for _ in range(n)] for n in (2, 8, 9, 64, 65, 66, 130)]
    rows = [ws[:i] + ws[i + 1 :] for ws in pool for i in range(len(ws))] + pool
    out = lines.with_variants(spark.createDataFrame([(ws,) for ws in rows if ws], "words array<string>")).collect()
    whole = {tuple(x["words"]): x["whole"] for x in out}
    assert len(set(whole.values())) == len(whole)
    for x in out:
        ws = tuple(x["words"])
        assert len(x["keys"]) == len(ws)
        if list(ws) in pool:
            assert x["keys"] == [whole[ws[:i] + ws[i + 1 :]] for i in range(len(ws))]


def test_map_of_keys(spark):
    """No key of the map is missed, and few others are hit."""
    rows = spark.range(40_000).selectExpr("id", "cast(id % 7 as int) n")
    hit = {r["id"] for r in lines.marked(rows, lines.bit_map(rows.where("id % 4 = 0"), "id", "n"), "id", "n").where("hit").collect()}
    assert {i for i in range(0, 40_000, 4)} <= hit
    assert len(hit) < 10_100
    assert lines.marked(rows, lines.bit_map(rows.limit(0), "id", "n"), "id", "n").where("hit").count() == 0


def test_line_dedup_shuffles_little(spark):
    """Where no join is small enough to be broadcast, as at size: variants and lines that can't meet another go through no join."""

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        kinds, none = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark._jsparkSession.sparkContext().statusStore().stageList(kinds, False, False, none, spark._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        before = shuffled()
        lines.dedup(docs).write.format("noop").mode("overwrite").save()
        total = sum(n for k, n in shuffled().items() if k not in before)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert 0 < total < 1.2 * size, total / size


def brute_near(rows, width, percent):
    sets = []
    for _, t in rows:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} - {()})
    ids = [i for i, _ in rows]
    group = {i: i for i in ids}
    changed = True
    links = [(a, b) for x, a in enumerate(ids) for y, b in enumerate(ids) if a is not None and b is not None and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])]
    while changed:
        changed = False
        for a, b in links:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    return sorted(((i, len(s), group[i], i is None or group[i] == i) for i, s in zip(ids, sets, strict=True)), key=repr)


@pytest.mark.parametrize(("seed", "width", "hubs"), [(1, 4, 4), (2, 5, 1)])
def test_near_duplicates(spark, seed, width, hubs):
    rows = corpus(seed, n=90, words=60)
    out = minhash.near_duplicates(frame(spark, rows), width=width, hubs=hubs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out), key=repr) == brute_near(rows, width, 80)
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies at all distances from one text: some link with the text, some with each other, some with nothing."""
    r = random.Random(5)
    lex = [f"u{i}" for i in range(3000)]
    base = [r.choice(lex) for _ in range(120)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 9, 14])):
            ws[r.randrange(len(ws))] = r.choice(lex)
        rows.append((i, " ".join(ws)))
    out = minhash.near_duplicates(frame(spark, rows), width=4, hubs=1).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in out), key=repr) == brute_near(rows, 4, 80)


def test_near_duplicates_shuffle_little(spark):
    """Where no join is small enough to be broadcast, as at size: whole sets travel only for pairs that their bitmaps allow."""

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        kinds, none = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark._jsparkSession.sparkContext().statusStore().stageList(kinds, False, False, none, spark._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        before = shuffled()
        minhash.near_duplicates(docs, width=4).write.format("noop").mode("overwrite").save()
        total = sum(n for k, n in shuffled().items() if k not in before)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert 0 < total < size, total / size


def test_bitmaps_rule_out_no_link(spark):
    """Pairs of similar sets all stay, those of rows that share an id too; most others go."""
    r = random.Random(9)
    texts = {}
    for i in range(0, 80, 2):
        ws = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 9, 60, 300]))]
        texts[i] = [" ".join(ws)]
        for k in range(r.choice([0, 1, 2, 7, 20])):
            ws[r.randrange(len(ws))] = f"x{k}"
        texts[i + 1] = [" ".join(ws), "another text of the same id"]
    sets = minhash.stored_sets(frame(spark, [(i, t) for i, ts in texts.items() for t in ts]), spark.range(80).toDF("node"), "doc_id", "text", 2)
    shingles = {i: [set(zip(ws, ws[1:], strict=False)) for ws in (t.split() for t in ts)] for i, ts in texts.items()}
    linked = {(a, b) for a in texts for b in texts if a < b and any(100 * len(x & y) >= 80 * len(x | y) for x in shingles[a] for y in shingles[b])}
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "a long, b long")
    left = {(x["a"], x["b"]) for x in minhash.possible(pairs, sets, 80).collect()}
    assert linked <= left
    assert len(left - linked) < 300
    assert {(x["a"], x["b"]) for x in minhash.verified(pairs, sets, 80).collect()} == linked


def test_super_minhash_estimates_similarity():
    import numpy as np

    rng, errors = np.random.default_rng(1), []
    for _ in range(30):
        x = rng.integers(0, 2**63, 500).astype(np.uint64)
        s = minhash.super_minhash(np.repeat([0, 1], 450), np.concatenate([x[:450], x[50:]]), 2, 128)
        errors.append((s[0] == s[1]).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02


def test_components_in_rounds(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(2000, 2100)]
    group: dict = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            group[max(a, b)] = min(a, b)
    expected = sorted((x, find(x)) for x in group)
    df = spark.createDataFrame(links, "a long, b long")
    for task_links in (20, 500_000):
        assert sorted(map(tuple, common.components(df, task_links).collect())) == expected
    assert common.components(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """Texts of 60,000 words, one line each, an altered copy and a tail among them, in every dedup operator."""
    r = random.Random(5)
    ws = [f"w{r.randrange(30_000)}" for _ in range(60_000)]
    altered, other = list(ws), [f"u{r.randrange(30_000)}" for _ in range(60_000)]
    for k in range(0, 60_000, 200):
        altered[k] = "changed"
    one = list(ws)
    one[31_000] = "edit"
    rows = [(4, " ".join(ws)), (3, " ".join(altered)), (9, " ".join(other)), (7, " ".join(one)), (1, "a few words"), (8, None), (6, "x" * 300_000)]
    df = frame(spark, rows)
    assert sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring.dedup(df).collect()), key=repr) == brute_substring(rows)
    near = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(df).collect()}
    assert near == {4: 3, 3: 3, 7: 3, 9: 9, 1: 1, 8: 8, 6: 6}
    left = {x["doc_id"]: (x["n_lines"], x["n_removed"]) for x in lines.dedup(df).collect()}
    assert left == {4: (1, 0), 3: (1, 0), 7: (1, 1), 9: (1, 0), 1: (1, 0), 8: (0, 0), 6: (1, 0)}


def test_rows_of_one_id_with_different_texts(spark):
    """Lines of such rows are judged apart; their sets are one document's."""
    r = random.Random(6)
    text = lambda: " ".join(f"t{r.randrange(900)}" for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(5, a), (5, b), (5, a), (6, b), (7, c), (None, c), (None, a + "\n" + c)]
    out = [(x["doc_id"], x["n_removed"], x["text"]) for x in lines.dedup(frame(spark, rows)).collect()]
    assert sorted((i, n) for i, n, _ in out if i is not None) == [(5, 0), (5, 0), (5, 0), (6, 1), (7, 0)]
    assert sorted((n, t) for i, n, t in out if i is None) == [(1, ""), (2, "")]
    near = sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert near == sorted([(5, 5, True)] * 3 + [(6, 5, False), (7, 7, True)] + [(None, None, True)] * 2, key=repr)


def test_scratch_is_dropped(spark):
    df = common.materialize(spark.range(3).toDF("x"), "gone")
    assert df.count() == 3
    common.drop_scratch(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(common.application_dir(spark))
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
