"""A library through its requests, from new tapes to a restore."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from shelfline import schema
from shelfline.api import Library
from shelfline.operators.scans import NotFound
from shelfline.sources.snapshots import Catalog


def test_library(spark, tmp_path):
    (tmp_path / "src" / "d").mkdir(parents=True)
    (tmp_path / "src" / "d" / "one").write_bytes(b"12345")
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "1.log").write_text("hello")
    lib = Library(Catalog(spark, f"file://{tmp_path}/catalog"), str(tmp_path / "src"), str(tmp_path / "logs"))
    now = dt.datetime(2024, 1, 2)
    for i in (1, 2):
        tape = spark.createDataFrame([(i, f"T{i:05}", "", "", now, None, 0, 0)], schema.TAPE)
        rows = [(f"x/f{k}", k + 1, 0o644, now, now, hashlib.sha256(bytes([k])).digest()) for k in range(i, i + 3)]
        assert lib.add_tape(tape, spark.createDataFrame(rows, schema.TAPE_FILE)).isEmpty()
    assert lib.tape_list().count() == 2 and lib.tape_list(mget=[2]).first()["writen_bytes"] == 12
    assert [r["path"] for r in lib.tape_get_positions(1).collect()] == ["x/"]
    top = lib.file_get(0)["children"].collect()
    assert [r["name"] for r in top] == ["Unforged"]
    made = lib.file_mkdir(0, "kept/here")
    lib.file_edit(top[0]["id"], parent_id=made, name="all")
    # four contents on two tapes: the two that both hold hang on one file each
    assert lib.files.where("mode = 420").count() == 4
    one = lib.files.where("name = 'f2'").first()["id"]
    assert [r["name"] for r in lib.file_list_parents(one).collect()] == ["kept", "here", "all", "T00001", "x", "f2"]
    assert lib.file_get(one)["positions"].count() == 2
    assert lib.file_get(made, need_size=True)["children"].first()["size"] == 2 + 3 + 4 + 5
    with pytest.raises(NotFound):
        lib.file_get(10**6)
    job = lib.job_create_restore([made])
    state = lib.job_list(mget=[job]).first()["state"]["restore"]
    assert [(t["tape_id"], len(t["files"])) for t in state["tapes"]] == [(1, 3), (2, 1)]
    lib.job_dispatch(job, schema.JOB_STEP["WAIT_FOR_TAPE"])
    assert lib.job_list(status=schema.JOB_STATUS["PROCESSING"]).count() == 1
    with pytest.raises(ValueError):
        lib.job_dispatch(job, schema.JOB_STEP["FINISHED"])
    live = spark.createDataFrame([(job, 1, 1, 1), (99, 1, 1, 1)], "id long, copied_bytes long, copied_files long, speed long")
    assert lib.job_display(job, live).count() == 1 and lib.job_display(99, live).count() == 0
    progress = spark.createDataFrame([(job, now, 5, 1), (job, now + dt.timedelta(seconds=2), 9, 2)], "job_id long, t timestamp, bytes long, files long")
    card = lib.job_display(job, progress=progress).first()
    assert (card["total_files"], card["copied_files"], card["copied_bytes"], card["eta_s"]) == (4, 2, 9, 3)
    lib.job_dispatch(job, schema.JOB_STEP["COPYING"])
    with pytest.raises(ValueError, match="left"):
        lib.job_dispatch(job, schema.JOB_STEP["FINISHED"])
    other = lib.job_create_archive("d")
    sources = lib.job_list(mget=[other]).first()["state"]["archive"]["sources"]
    assert [(s["source"]["path"], s["size"], s["status"]) for s in sources] == [(["one"], 5, 1)]
    lib.job_delete([other])
    assert lib.job_list().count() == 1 and lib.job_list(recent_after_ns=0).count() == 2
    lib.tape_delete([2])
    lib.library_trim()
    assert lib.positions.count() == 3 and lib.files.where("mode = 420").count() == 3
    doc = lib.library_export(["file"]).first()["json"]
    (tmp_path / "doc.json").write_text(doc)
    before = sorted(r["name"] for r in lib.files.collect())
    lib.file_delete([made])
    lib.library_import(str(tmp_path / "doc.json"))
    assert sorted(r["name"] for r in lib.files.collect()) == before
    assert lib.job_get_log(1).first()["text"] == "hello" and lib.source_get_size().first()["size"] == 5
    assert lib.source_list("d")["children"].first()["name"] == "one" and lib.source_list("d")["chain"].count() == 2
    assert [r["device"] for r in lib.device_list(["b", "a", "b"]).collect()] == ["a", "b"]
    assert lib.files.where(F.col("mode").isNull()).isEmpty()


def test_command_line(spark, tmp_path, capsys):
    from shelfline.__main__ import main

    store = Catalog(spark, f"file://{tmp_path}/catalog")
    store.commit({"file": spark.createDataFrame([(1, 0, "f", 0o644, None, None, 4, None)], schema.FILE)})
    main(["export", f"file://{tmp_path}/catalog", str(tmp_path / "out"), "--types", "file,tape"])
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).replace("\n", "")
    assert whole == '{"files":[{"id":1,"name":"f","mode":420,"size":4}],"tapes":[]}'
    raw = spark.createDataFrame([("c", 0x0405, bytearray(b"\x42")), ("c", 0x0001, bytearray((1000).to_bytes(8, "big")))], "cartridge string, command int, data binary")
    raw.write.parquet(str(tmp_path / "attributes"))
    main(["cartridge", str(tmp_path / "attributes")])
    assert "LTO-2" in capsys.readouterr().out
