"""Operators on small hand-written catalogs, with the decided behaviour of each odd case."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfline import schema
from shelfline.functions import values
from shelfline.operators import jobs, listing, mutations, scans, telemetry
from shelfline.plans import restore, tree, trim
from shelfline.sources import catalog_json, filesystem
from shelfline.sources.filesystem import crumbs, listing as list_folder, sources, total_size
from shelfline.sources.logs import append_log, log_path, log_tail, write_report
from shelfline.sources.snapshots import Catalog, ConcurrentCommit

DIR, FILE = 0x80000000 | 0o777, 0o644
T = [dt.datetime(2024, 1, d) for d in range(1, 29)]


def files(spark, rows):
    """(id, parent, name, mode[, size, hash])"""
    full = []
    for r in rows:
        i, parent, name, mode, *rest = r
        size, sha = (*rest, *(0, None)[len(rest) :])
        sig = None if sha is None else b"\x01" + sha + size.to_bytes(8, "big")
        full.append((i, parent, name, mode, T[0], sha, size, sig))
    return spark.createDataFrame(full, schema.FILE)


def positions(spark, rows):
    """(id, file, tape, path[, write day, size, hash])"""
    full = []
    for r in rows:
        i, file, tape, path, *rest = r
        day, size, sha = (*rest, *[0, 1, None][len(rest) :])
        full.append((i, file, tape, path, FILE, T[0], T[day], size, sha))
    return spark.createDataFrame(full, schema.POSITION)


def tapes(spark, *ids):
    return spark.createDataFrame([(i, f"T{i:05}", "", "", T[i], None, 0, 0) for i in ids], schema.TAPE)


TREE = [(1, 0, "a", DIR), (2, 1, "b", DIR), (3, 2, "f", FILE, 5), (4, 1, "g", FILE, 7), (5, 0, "e", DIR), (6, 0, "h", FILE, 1)]


def test_empty_catalog(spark):
    f, p, t = files(spark, []), positions(spark, []), tapes(spark)
    assert listing.tape_directory(p, 1).count() == 0 and tree.directory_usage(f).collect()[0]["total_size"] == 0
    assert tree.ancestors(f, spark.range(3)).count() == 0 and tree.full_paths(f).count() == 0
    a, b = trim.trim(f, p, t)
    assert a.count() == b.count() == 0
    assert restore.plan(f, p, t, spark.range(1)).count() == 0
    with pytest.raises(scans.NotFound):
        scans.get(f, 1)


def test_listing_order(spark):
    p = positions(spark, [(1, 1, 1, "a/x", 3, 10), (2, 1, 1, "a/y/z", 5, 20), (3, 1, 1, "a!", 1, 1), (4, 1, 1, "a-b/c", 1, 2), (5, 1, 2, "other", 1, 2), (6, 1, 1, "%x", 1, 1)])
    rows = listing.tape_directory(p, 1).collect()
    assert [(r["path"], r["size"], r["id"]) for r in rows] == [("%x", 1, 6), ("a/", 30, 0), ("a!", 1, 3), ("a-b/", 2, 0)]
    folder = rows[1]
    assert folder["write_time"] == T[5] and folder["hash"] is None and folder["mode"] == DIR and folder["file_id"] == 0
    assert [r["path"] for r in listing.tape_directory(p, 1, "/a/").collect()] == ["a/x", "a/y/"]
    assert [r["path"] for r in listing.tape_directory(p, 1, "%").collect()] == []


def test_trim_order_and_switches(spark):
    f = files(spark, [(1, 0, "x", FILE), (2, 0, "y", FILE), (3, 0, "z", DIR), (4, 0, "w", FILE)])
    p = positions(spark, [(1, 1, 1, "a", 2), (2, 1, 1, "a", 3), (3, 1, 1, "a", 3), (4, 2, 9, "b"), (5, 1, 1, "c", 1), (6, 3, 1, "d", 1), (7, 3, 1, "d", 2)])
    a, b = trim.trim(f, p, tapes(spark, 1))
    assert sorted(r["id"] for r in b.collect()) == [2, 5, 6, 7]  # of equal times the lowest id, directories' places stay
    assert sorted(r["id"] for r in a.collect()) == [1, 3]
    a, b = trim.trim(f, p, tapes(spark, 1), trim_positions=False, trim_files=True)
    assert a.count() == 4 and b.count() == 7
    a, b = trim.trim(f, p, tapes(spark, 1), trim_files=False)
    assert a.count() == 4 and b.count() == 6


def test_linking(spark):
    x, y, z = (hashlib.sha256(c).digest() for c in (b"x", b"y", b"z"))
    f = files(spark, [(1, 0, "f", FILE, 4, x), (2, 0, "g", FILE, 4, x), (3, 0, "Unforged", DIR), (4, 3, "T00001", DIR), (5, 4, "taken", FILE)])
    p = positions(spark, [(1, 0, 1, "p/one", 0, 4, x), (2, 0, 1, "p/two", 0, 4, x), (3, 0, 1, "n/new", 0, 9, y), (4, 0, 2, "n/other", 0, 9, y), (5, 0, 8, "lost", 0, 2, z), (6, 0, 1, "taken", 0, 3, z), (7, 3, 1, "old")])
    nf, np_, clashes = trim.link_new_positions(f, p, tapes(spark, 1, 2))
    linked = {r["id"]: r["file_id"] for r in np_.collect()}
    assert linked[1] == linked[2] == 1 and linked[3] == linked[4] > 5 and linked[5] == linked[6] == 0 and linked[7] == 3
    assert [r["target"] for r in clashes.collect()] == ["Unforged/T00001/taken"]
    paths = {r["full_path"] for r in tree.full_paths(nf).collect()}
    assert "Unforged/T00001/n/new" in paths and "Unforged/T00002" not in paths
    made = nf.where("name = 'n'").first()
    assert made["mode"] == DIR


def test_tree(spark):
    f = files(spark, TREE)
    use = {r["id"]: (r["total_size"], r["total_files"]) for r in tree.directory_usage(f).collect()}
    assert use == {0: (13, 3), 1: (12, 2), 2: (5, 1), 5: (0, 0)}
    assert [(r["name"], r["size"]) for r in tree.usage_below(f, 0).collect()] == [("a", 12), ("e", 0), ("h", 1)]
    up = tree.ancestors(f, spark.createDataFrame([(3,), (0,), (77,)], "id long")).orderBy("steps", ascending=False).collect()
    assert [r["name"] for r in up] == ["a", "b", "f"] and not any(r["broken"] for r in up)
    assert all(r["broken"] for r in tree.ancestors(files(spark, [(9, 8, "x", FILE)]), spark.createDataFrame([(9,)], "id long")).collect())
    assert {r["root"]: r["holds_files"] for r in tree.holds_files(f, spark.createDataFrame([(1,), (5,)], "root long")).collect()} == {1: True, 5: False}


def test_deep_trees_and_cycles(spark):
    chain = files(spark, [(i, i - 1, f"d{i}", DIR) for i in range(1, 36)])
    up = tree.ancestors(chain, spark.createDataFrame([(35,)], "id long"))
    assert up.count() == tree.MAX_ANCESTORS
    loop = files(spark, [(1, 2, "a", DIR), (2, 1, "b", DIR)])
    with pytest.raises(tree.TooDeep):
        tree.directory_usage(loop, max_depth=5)
    with pytest.raises(tree.TooDeep):
        tree.descendants(loop, spark.createDataFrame([(1,)], "root long"), max_depth=5)


def test_many_ids_are_not_broadcast(spark):
    """The tables of 120,000 ids are some 1 MB of files: their rows, not their files, tell that they are no broadcast."""
    n = 120_000
    rows = spark.range(1, n + 1).select("id", F.lit(n + 1).alias("parent_id"), F.lit("f").alias("name"), F.lit(FILE).cast("long").alias("mode"))
    folders = spark.range(n + 1, n + 3).select("id", (F.when(F.col("id") == n + 1, n + 2).otherwise(0)).cast("long"), F.lit("d"), F.lit(DIR).cast("long"))
    files_ = rows.unionByName(folders.toDF(*rows.columns)).unionByName(spark.range(2 * n, 3 * n).select("id", (F.col("id") + n).alias("parent_id"), F.lit("f").alias("name"), F.lit(FILE).cast("long").alias("mode")))
    files_ = files_.unionByName(spark.range(3 * n, 4 * n).select("id", F.lit(n + 2).cast("long").alias("parent_id"), F.lit("d").alias("name"), F.lit(DIR).cast("long").alias("mode")))
    up = tree.ancestors(files_, files_.where(f"mode = {FILE}").select("id"))
    assert "BroadcastHashJoin" not in up._jdf.queryExecution().executedPlan().toString()
    assert {(r["steps"], r["broken"], r["count"]) for r in up.groupBy("steps", "broken").count().collect()} == {(0, False, 2 * n), (1, False, 2 * n), (2, False, 2 * n)}


def test_restore_prunes_nested_roots(spark):
    f = files(spark, TREE)
    chosen = spark.createDataFrame([(1,), (2,), (3,), (6,), (6,)], "id long")
    assert sorted(r["id"] for r in restore.pruned_roots(f, chosen).collect()) == [1, 6]
    assert sorted(r["target_path"] for r in restore.expand(f, chosen).collect()) == ["a/b/f", "a/g", "h"]


def test_greedy_cover_ties(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 11), (3, 11), (3, 12)], "tape_id long, file_id long")
    steps = {r["file_id"]: (r["step"], r["tape_id"]) for r in restore.greedy_cover(pairs).collect()}
    assert steps == {10: (0, 1), 11: (0, 1), 12: (1, 3)}
    f = files(spark, TREE)
    p = positions(spark, [(1, 3, 1, "b"), (2, 4, 1, "a"), (3, 3, 1, "0"), (4, 6, 9, "gone")])
    rows = restore.plan(f, p, tapes(spark, 1), spark.createDataFrame([(1,), (6,)], "id long"))
    assert [(r["position_id"], r["target_path"]) for r in rows.collect()] == [(2, "a/g"), (1, "a/b/f")]
    state = restore.plan_state(rows).first()
    assert state["step"] == 0 and [x["position_id"] for x in state["tapes"][0]["files"]] == [2, 1]


def test_move_and_edit(spark):
    f = files(spark, [*TREE, (7, 5, "b", DIR), (8, 7, "f2", FILE, 2), (9, 5, "h", FILE, 1)])
    assert mutations.move(f, 2, 1, "b") is f
    merged = {r["id"]: r for r in mutations.move(f, 2, 5, "b").collect()}
    assert 2 not in merged and merged[3]["parent_id"] == 7
    with pytest.raises(FileExistsError):
        mutations.move(f, 6, 5, "h")
    with pytest.raises(ValueError):
        mutations.move(f, 1, 2, "x")
    renamed = {r["full_path"] for r in tree.full_paths(mutations.edit(f, 6, name="n\\m")).collect()}
    assert "n/m" in renamed and "h" not in renamed
    with pytest.raises(ValueError):
        mutations.edit(f, 6, name="  ")
    with pytest.raises(ValueError):
        mutations.make_directories(f, spark.createDataFrame([("/",)], "path string"))
    with pytest.raises(FileExistsError):
        mutations.make_directories(f, spark.createDataFrame([("h/x",)], "path string"))


def test_trash(spark):
    f = files(spark, TREE)
    now = F.to_timestamp(F.lit("2024-05-06 07:08:09"))
    out = mutations.delete(f, [1, 5], now)
    paths = {r["full_path"]: r["id"] for r in tree.full_paths(out).collect()}
    stamp = ".Trash/2024-05-06T07:08:09Z"
    assert f"{stamp}/a/b/f" in paths and f"{stamp}/e" in paths and paths[".Trash"] == schema.TRASH_ID
    again = {r["full_path"] for r in tree.full_paths(mutations.delete(out, [1, 5], now)).collect()}
    assert f"{stamp}/a/b/f" in again and f"{stamp}/e" not in again


def test_jobs(spark):
    none = F.lit(None)
    table = spark.createDataFrame([(1, 2, 1, 5, 5), (2, 3, 9, 6, 5), (3, 255, 0, 7, 5), (4, 2, 3, 1, 9)], "id long, status int, priority long, create_time_ns long, update_time_ns long").withColumn("state", none.cast(schema.JOB.split("state ")[1]))
    assert [r["id"] for r in scans.list_jobs(table).collect()] == [2, 1, 4]
    assert [r["id"] for r in scans.recent_jobs(table, 4).collect()] == [1, 2, 3, 4] and [r["id"] for r in scans.recent_jobs(table, 5, 2).collect()] == [3, 4]
    assert scans.next_job(table).first()["id"] == 4
    with pytest.raises(ValueError):
        mutations.edit_job_state(table, 2, 2, None, F.lit(8))
    with pytest.raises(ValueError):
        mutations.edit_job_state(table, 1, 3, None, F.lit(8))
    assert mutations.edit_job_state(table, 1, 4, None, F.lit(8).cast("long")).where("id = 1").first()["status"] == 4
    saved = mutations.save_jobs(table, table.where("id = 1").withColumn("create_time_ns", F.lit(0).cast("long")), F.lit(99).cast("long")).where("id = 1").first()
    assert (saved["create_time_ns"], saved["update_time_ns"]) == (99, 99)
    made = jobs.new_job(table, none, 3, F.lit(1).cast("long"))
    assert made.count() == 5 and made.agg(F.max("id")).first()[0] == 5 and jobs.exactly_one_kind(made).count() == 5
    plan = spark.createDataFrame([(["b"], 1), (["a", "z"], 2), (["a"], 3)], "path array<string>, size long")
    assert [r["path"] for r in jobs.archive_plan(plan, "/").collect()] == [["a"], ["a", "z"], ["b"]]
    with pytest.raises(ValueError):
        jobs.archive_plan(plan.unionByName(plan), "/")
    assert jobs.normal_base("x", "/src") == "/src/x/" and jobs.normal_base("/x", "/src") == "/x/"
    state = spark.createDataFrame([("a", 4), ("b", 3)], "path string, status int")
    assert [r["status"] for r in jobs.release_unsubmitted(state).orderBy("path").collect()] == [4, 1]
    assert [r["status"] for r in jobs.record_sources(state, spark.createDataFrame([("b",)], "path string")).orderBy("path").collect()] == [4, 4]
    assert jobs.report_sources(spark.createDataFrame([("b", 0), ("a", 1)], "path string, successes int"), state).count() == 1


def test_speed_edges(spark):
    day = T[0]
    rows = [(1, day, 5), (1, day, 9), *[(1, day + dt.timedelta(seconds=i), 10 * i) for i in range(1, 40)], (2, day, 10**15), (2, day + dt.timedelta(seconds=1), 9 * 10**18)]
    got = telemetry.copy_speed(spark.createDataFrame(rows, "job_id long, t timestamp, bytes long")).orderBy("job_id", "t", "bytes").collect()
    assert [r["speed"] for r in got[:2]] == [0, None] and got[40]["speed"] == 10
    assert got[-1]["speed"] == 9 * 10**18 - 10**15


def test_catalog_json_round_trip(spark, tmp_path):
    sha = hashlib.sha256(b"x").digest()
    f = files(spark, [(-1, 0, ".Trash", DIR), (1, 0, "f", FILE, 4, sha), (2, -1, "", FILE)])
    t = tapes(spark, 1, 2).withColumn("destroy_time", F.when(F.col("id") == 2, F.lit(T[3])))
    doc = catalog_json.export_document({"file": f, "tape": t}, ["FILE", "tape", "nothing", "file"]).first()["json"]
    assert '"positions"' not in doc and '"size":0' not in doc
    (tmp_path / "doc.json").write_text(doc)
    back = catalog_json.import_document(spark, str(tmp_path / "doc.json"))
    assert set(back) == {"file", "tape"}
    for kind, df in (("file", f), ("tape", t)):
        blank = {c: "" for c, k in df.dtypes if k == "string"}
        assert sorted(map(repr, back[kind].na.fill(blank).collect())) == sorted(map(repr, df.na.fill(blank).collect()))
    with pytest.raises(ValueError):
        catalog_json.kinds(["x"])


def test_snapshots(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/catalog")
    assert store.read("tape", schema.TAPE).count() == 0
    store.commit({"tape": tapes(spark, 1, 2)}, {"tape": ["id"]})
    before = store.read("tape")
    store.commit({"tape": mutations.delete_tapes(before, [1])})
    assert [r["id"] for r in store.read("tape").collect()] == [2] and before.count() == 2
    with pytest.raises(LookupError):
        store.read("none")


def test_filesystem_and_logs(spark, tmp_path):
    root = tmp_path / "src"
    (root / "d" / "e").mkdir(parents=True)
    for name, n in (("x", 3), ("d/y", 4), ("d/e/z.txt", 5), (".DS_Store", 9)):
        (root / name).write_bytes(b"q" * n)
    assert [r["path"] for r in sources(spark, str(root)).collect()] == [["d", "e", "z.txt"], ["d", "y"], ["x"]]
    assert total_size(spark, str(root)).first()["size"] == 12
    assert [(r["name"], r["is_dir"], r["size"]) for r in list_folder(spark, str(root)).collect()] == [("d", True, 9), ("x", False, 3)]
    trail = spark.range(1).select(crumbs(F.lit("/a/b")).alias("c")).first()["c"]
    assert [(c["path"], c["parent_path"], c["name"]) for c in trail] == [("./", "", "Root"), ("a/", "./", "a"), ("a/b/", "a/", "b")]
    log = tmp_path / "1.log"
    log.write_text("one\ntwo\n")
    assert tuple(log_tail(spark, str(log), 4).first()) == ("two\n", 8) and tuple(log_tail(spark, str(log), 8).first()) == ("", 8)
    out = str(tmp_path / "reports")
    write_report(spark.createDataFrame([("A", 1), ("B", 2)], "barcode string, n int"), out)
    write_report(spark.createDataFrame([("A", 3)], "barcode string, n int"), out)
    assert {p.name: p.read_text() for p in (tmp_path / "reports").glob("*.log")} == {"A.log": '{"n":3}\n', "B.log": '{"n":2}\n'}
    for lines in ([(1, "l"), (2, "x")], [(1, "m"), (1, "n")]):
        append_log(spark.createDataFrame(lines, "job_id long, line string"), str(tmp_path / "logs"))
    first = log_tail(spark, log_path(str(tmp_path / "logs"), 1), 0, limit=3).first()
    assert tuple(first) == ("l\nm", 3) and tuple(log_tail(spark, log_path(str(tmp_path / "logs"), 1), 3).first()) == ("\nn\n", 6)
    assert log_tail(spark, log_path(str(tmp_path / "logs"), 2)).first()["text"] == "x\n"


def test_entries_of_one_folder(spark, tmp_path):
    for name in ("empty", "_dir", ".git"):
        (tmp_path / name).mkdir()
    for name, n in (("a.txt", 3), (".env", 2), ("_dir/deep", 9)):
        (tmp_path / name).write_bytes(b"q" * n)
    got = [(r["name"], r["is_dir"], None if r["is_dir"] else r["size"]) for r in filesystem.entries(spark, str(tmp_path)).collect()]
    assert got == [(".env", False, 2), (".git", True, None), ("_dir", True, None), ("a.txt", False, 3), ("empty", True, None)]
    assert filesystem.entries(spark, str(tmp_path / "a.txt")).count() == 0


def test_log_bytes(spark, tmp_path):
    """Offsets inside a character, a character still being written, and bytes that are no text."""
    log = tmp_path / "1.log"
    log.write_bytes("aé€\U0001f600".encode() + b"\x80b")
    assert tuple(log_tail(spark, str(log), 2).first()) == ("\ufffd€\U0001f600\ufffdb", 12)
    assert tuple(log_tail(spark, str(log), 0, limit=2).first()) == ("a", 1)
    assert tuple(log_tail(spark, str(log), 1, limit=4).first()) == ("é", 3)
    log.write_bytes(b"ab\xe2\x82")
    assert tuple(log_tail(spark, str(log)).first()) == ("ab", 2)
    with log.open("ab") as f:
        f.write(b"\xac")
    assert tuple(log_tail(spark, str(log), 2).first()) == ("€", 5)
    with pytest.raises(FileNotFoundError):
        log_tail(spark, str(tmp_path / "none.log"))


def test_document_of_parts(spark, tmp_path):
    f, t = files(spark, [(-1, 0, ".Trash", DIR), (1, 0, "f", FILE, 4), (7, -1, "g", FILE)]), tapes(spark, 1, 2)
    catalog_json.write_document({"file": f, "tape": t}, str(tmp_path / "doc"), ["file", "tape"])
    whole = tmp_path / "doc.json"
    whole.write_text("".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*"))))
    back = catalog_json.import_document(spark, str(whole))
    assert sorted(r["id"] for r in back["file"].collect()) == [-1, 1, 7] and back["tape"].count() == 2
    again = catalog_json.import_rows(catalog_json.export_rows({"file": f, "tape": t}, ["file", "tape"]))
    assert sorted(map(repr, again["file"].collect())) == sorted(map(repr, back["file"].collect()))


def test_commits_at_one_time(spark, tmp_path):
    """Two writers of two tables both stand; of one table the later is refused; a pointer is whole or not there."""
    root = f"file://{tmp_path}/catalog"
    one, two = Catalog(spark, root), Catalog(spark, root)
    one.commit({"tape": tapes(spark, 1), "file": files(spark, [(1, 0, "f", FILE)])})

    class Between(Catalog):
        def versions(self):
            now = super().versions()
            two.commit({"tape": tapes(spark, 1, 2)})
            return now

    Between(spark, root).commit({"file": files(spark, [(1, 0, "f", FILE), (2, 0, "g", FILE)])})
    assert one.read("tape").count() == 2 and one.read("file").count() == 2
    with pytest.raises(ConcurrentCommit):
        Between(spark, root).commit({"tape": tapes(spark, 9)})
    assert one.read("tape").count() == 2
    number, _ = one._latest()
    assert not one._publish(number, {}) and one._latest()[0] == number
    (tmp_path / "catalog" / "new-broken").write_text("{")  # what a crash between the steps leaves
    assert one.read("file").count() == 2


def test_cover_by_classes_and_by_rounds(spark):
    """A thousand tapes: both ways give the same steps, and every file is covered."""
    pairs = spark.range(6000).select(F.explode(F.array(F.pmod(F.xxhash64("id"), F.lit(1000)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)) + 2000)).alias("tape_id"), (F.col("id") % 3000).alias("file_id")).distinct()
    got = restore.greedy_cover(pairs)
    assert got.select("file_id").distinct().count() == got.count() == 3000
    few = pairs.where("tape_id < 30 or tape_id = 2001")
    assert sorted(map(tuple, restore.greedy_cover(few).collect())) == sorted(map(tuple, restore.greedy_cover(few, driver_entries=0).collect()))


def test_cover_takes_many_tapes_a_round(spark):
    """Few entries at once, few rounds, the steps of one tape at a time; a cut after some steps is a start of the whole."""
    rows = sorted({(random.Random(f * 50 + k).randrange(300) * 3 + 5, f) for f in range(1200) for k in range(4)})
    held: dict[int, set] = {}
    for tape, f in rows:
        held.setdefault(tape, set()).add(f)
    expected = []
    while left := {t: len(f) for t, f in held.items() if f}:
        tape = min(left, key=lambda t: (-left[t], t))
        taken = held[tape]
        expected += [(len({e[0] for e in expected}), tape, f) for f in taken]
        held = {t: f - taken for t, f in held.items()}
    pairs = spark.createDataFrame(rows, "tape_id long, file_id long")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("cover"))
    spark.sparkContext.setJobGroup("cover", "cover")
    try:
        got = restore.greedy_cover(pairs, driver_entries=2500)
        assert 0 < jobs() < len({e[0] for e in expected})
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert sorted(map(tuple, restore.greedy_cover(pairs, max_steps=9, driver_entries=500).collect())) == sorted(e for e in expected if e[0] < 9)
    assert restore.greedy_cover(pairs.where("false")).count() == 0


def test_a_cycle_is_reported(spark):
    tree_ = files(spark, [(1, 2, "a", DIR), (2, 1, "b", DIR), (3, 2, "c", FILE)])
    with pytest.raises(tree.TooDeep):
        tree.descendants(tree_, spark.createDataFrame([(1,)], "root long")).collect()


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(bytearray(b"\x80VENDOR \x00SER\xff \x00"),)], "b binary")
    row = df.select(values.ascii_text(F.col("b")).alias("t"), values.vendor_serial(F.col("b")).alias("v"), values.inquiry(F.col("b")).alias("q")).first()
    assert row["t"].startswith("\ufffdVENDOR") and row["v"]["serial"].startswith("SER")


def test_walk_takes_hidden_files(spark, tmp_path):
    root = tmp_path / "src"
    names = ["a.txt", "__init__.py", ".env", "_b/f.txt", ".c/f.txt", "d/g.txt", "d/.e/_f/h"]
    for n, name in enumerate([*names, "d/.DS_Store"], 1):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"q" * n)
    assert sorted("/".join(r["path"]) for r in sources(spark, str(root)).collect()) == sorted(names)
    assert [(r["name"], r["is_dir"], r["size"]) for r in list_folder(spark, f"file://{root}").collect() if r["name"] in (".env", "_b", ".c")] == [(".c", True, 5), (".env", False, 3), ("_b", True, 4)]
    assert total_size(spark, str(root), every=True).first()["size"] == sum(range(1, 9))
    at = spark._jvm.org.apache.hadoop.fs.Path(str(root))
    through_hadoop = filesystem._remote(spark, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at)
    assert sorted((r["path"], r["size"]) for r in through_hadoop.collect()) == sorted((r["path"], r["size"]) for r in filesystem.every_file(spark, str(root)).collect())
