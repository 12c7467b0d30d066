"""Queries over whole tables, beside the ones over subsets."""

from __future__ import annotations

import pytest

from shelfline import derive as d
from shelfline import queries as q
from tests.compare import connection, rows, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


def brute_cover(held: dict[int, set]) -> list[tuple[int, int, set]]:
    """``(step, tape, files)``: the tape with most files left takes them, of equals the lowest id."""
    out, done = [], set()
    while left := {t: f - done for t, f in held.items() if f - done}:
        tape = min(left, key=lambda t: (-len(left[t]), t))
        out.append((len(out), tape, left[tape]))
        done |= left[tape]
    return out


def held_files(spark, sf_dir, wanted: set) -> dict[int, set]:
    live = {r["id"] for r in d.tapes(spark, sf_dir).collect()}
    held: dict[int, set] = {}
    for p in d.positions(spark, sf_dir).collect():
        if p["tape_id"] in live and p["file_id"] in wanted:
            held.setdefault(p["tape_id"], set()).add(p["file_id"])
    return held


def test_restore_plan_all_against_brute_force(spark, sf_dir):
    got = q.QUERIES["restore_plan_all"](spark, sf_dir).collect()
    wanted = {r["id"] for r in d.part_files(spark, sf_dir).collect() if r["mode"] < 0x80000000}
    held = held_files(spark, sf_dir, wanted)
    first: dict[tuple, tuple] = {}
    for p in d.positions(spark, sf_dir).collect():
        key = (p["tape_id"], p["file_id"])
        first[key] = min(first.get(key, (p["id"], p["path"])), (p["id"], p["path"]))
    expected = []
    for step, tape, taken in brute_cover(held):
        files = sorted(taken, key=lambda f: (first[tape, f][1].replace("/", "\0"), f))
        expected += [(step, tape, n, f, *first[tape, f]) for n, f in enumerate(files, 1)]
    assert [(r["step"], r["tape_id"], r["seq"], r["file_id"], r["position_id"], r["tape_path"]) for r in got] == expected
    assert {r["file_id"] for r in got} == set().union(*held.values())


def test_restore_greedy_covers_every_file(spark, sf_dir, con):
    cover = q.QUERIES["restore_greedy"](spark, sf_dir)
    got = [(r["step"], r["tape_id"], r["file_id"]) for r in cover.collect()]
    held = held_files(spark, sf_dir, {r["id"] for r in d.part_files(spark, sf_dir).collect()})
    assert sorted(got) == sorted((step, tape, f) for step, tape, files in brute_cover(held) for f in files)
    assert {f for *_, f in got} == set().union(*held.values())
    same(cover.where("step < 3"), con, q.ORACLES["restore_greedy_3"])


def test_duplicate_sources_all_counts_every_position(spark, sf_dir):
    counts: dict[str, int] = {}
    for p in d.positions(spark, sf_dir).select("path").collect():
        first, _, third, *_ = p["path"].split("/")
        counts[f"{first}/{third}"] = counts.get(f"{first}/{third}", 0) + 1
    got = q.QUERIES["duplicate_sources_all"](spark, sf_dir)
    assert rows(got.columns, got.collect()) == sorted(((n, path) for path, n in counts.items() if n > 1), key=repr)


def test_queries_over_all_ids(spark, sf_dir):
    """Each takes all rows of its table, not a subset by id."""
    parts = {r["id"] for r in d.part_files(spark, sf_dir).collect()}
    files = {r["id"]: r["size"] for r in d.tree(spark, sf_dir).collect() if r["mode"] < 0x80000000}
    run = lambda name: q.QUERIES[name](spark, sf_dir).collect()
    held = {r["file_id"] for r in d.positions(spark, sf_dir).collect()}
    assert {r["file_id"] for r in run("positions_by_file_all")} == held & parts
    assert {r["id"] for r in run("file_detail_all")} == parts
    assert {r["start"] for r in run("file_parents_all")} == set(files)
    assert run("selection_size_all")[0]["total_size"] == sum(files.values())
    status = [r["status"] for r in d.jobs(spark, sf_dir).collect()]
    assert run("job_finished_all")[0]["finished"] == all(s in (4, 255) for s in status)
    ids = [r["doc_id"] for r in d.contents(spark, sf_dir).collect()]
    bad = {i % 7 for i in ids if any(i % n == 0 for n in (11, 13, 17))}
    assert {r["tape_id"] for r in run("restore_tape_status_all") if r["status"] == 255} == bad
