"""Column functions on hand-written rows."""

from __future__ import annotations

import posixpath

import pytest
from pyspark.sql import functions as F

from shelfline import schema
from shelfline.functions import cartridge, paths, values


def one(spark, column, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path", ["", ".", "/", "a", "a/b/", "//a//b", "/./a/../b", "../a", "a/../..", "/..", "/../x", "a/b/../../c", "./x", "../../a/../b"])
def test_clean_is_lexical(spark, path):
    want = posixpath.normpath(path)
    want = "/" + want.lstrip("/") if want.startswith("//") else want
    assert one(spark, paths.clean(F.col("p")), p=path) == want


def test_path_functions(spark):
    names = ["a", "a!", "a-b/c", "a/", "a/b"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "p string")
    assert [r["p"] for r in df.orderBy(paths.order_key(F.col("p"))).collect()] == ["a", "a/", "a/b", "a!", "a-b/c"]
    assert one(spark, paths.segments(F.col("p")), p="/ a // b c /") == ["a", "b c"]
    assert one(spark, paths.prefixes(F.col("p")), p="a/b/c") == ["a", "a/b", "a/b/c"]
    assert one(spark, paths.next_segment(F.col("p"), "x/"), p="x/y/z") == "y/"
    assert one(spark, paths.next_segment(F.col("p"), "x/"), p="x/y") == "y"
    assert one(spark, paths.extension(F.col("p")), p="a.tar.gz") == ".gz" and one(spark, paths.extension(F.col("p")), p="a") == ""
    assert one(spark, paths.hidden(F.col("p")), p=".a") and one(spark, paths.slashes(F.col("p")), p="a\\b") == "a/b"
    assert one(spark, paths.join(F.lit("a"), F.lit(""), F.lit("../b"))) == "b"
    assert one(spark, paths.trim_space(F.col("p")), p="  a\t") == "a"


def test_values(spark):
    assert one(spark, values.hex_lower(values.signature(F.unhex(F.lit("ab" * 32)), F.lit(258).cast("long")))) == "01" + "ab" * 32 + "0000000000000102"
    assert one(spark, values.unsigned(F.unhex(F.lit("ff" * 8)))) == 2**64 - 1
    assert one(spark, values.unhex_or_null(F.col("h")), h="0g") is None and one(spark, values.unhex_or_null(F.col("h")), h="0a") == b"\n"
    assert one(spark, values.vendor_serial(F.lit(b"HP      \0 1234 \0"))).asDict() == {"vendor": "HP", "serial": "1234"}
    reply = b"\0" * 8 + b"HP      " + b"Ultrium 2-SCSI  " + b"F63D"
    assert one(spark, values.inquiry(F.lit(reply))).asDict() == {"vendor": "HP", "model": "Ultrium 2-SCSI", "firmware": "F63D"}
    assert one(spark, values.barcode(F.lit("abc123l5"))) == "ABC123" and one(spark, values.json_barcode(F.lit('{"barcode":"x1"}'))) == "X1"
    assert [one(spark, values.file_size(F.lit(n).cast("long"))) for n in (0, 1023, 1024, 1536, 5 * 1024**4)] == ["0 B", "1023 B", "1 KB", "1.5 KB", "5 TB"]
    assert one(spark, values.rfc3339(F.lit("2024-05-06 07:08:09").cast("timestamp"))) == "2024-05-06T07:08:09Z"
    assert one(spark, values.progress(F.lit(1), F.lit(0))) == 100.0 and one(spark, values.eta_seconds(F.lit(5), F.lit(2))) == 3
    assert one(spark, values.to_nanos(values.from_nanos(F.lit(1_700_000_000_123_456_789)))) == 1_700_000_000_123_456_000


def test_log_pages(spark):
    pages = [b"\x11\0\0\x0f" + b"\0\1\0\2ab" + b"\0\2\0\1c", b"\x11\0\0\x08" + b"\0\1\0\x09a", None, b"\0\0\0\0"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p binary").select("i", values.log_page("p").alias("m"))
    assert [r["m"] for r in df.orderBy("i").collect()] == [{1: b"ab", 2: b"c"}, None, None, {}]


def test_modes_and_enums(spark):
    folder, link, plain = 0x80000000 | 0o755, 0x08000000 | 0o777, 0o644
    rows = spark.createDataFrame([(folder,), (link,), (plain,)], "m long").select(schema.is_dir(F.col("m")), schema.is_regular(F.col("m")), schema.permission(F.col("m"))).collect()
    assert [tuple(r) for r in rows] == [(True, False, "755"), (False, False, "777"), (False, True, "644")]
    assert one(spark, schema.enum_name(F.lit(3), schema.JOB_STATUS)) == "PROCESSING" and one(spark, schema.enum_name(F.lit(9), schema.JOB_STATUS)) == "UNKNOWN"
    assert one(spark, schema.enum_number(F.lit("tape"), schema.ENTITY_TYPE)) == 2


def test_cartridge_report(spark):
    eight = lambda n: n.to_bytes(8, "big")
    attributes = {0x0000: eight(198423), 0x0001: eight(200448), 0x0003: eight(42), 0x0220: eight(17476), 0x0400: b"FAKMANUF", 0x0405: b"\x42", 0x0406: b"20191231", 0x0408: b"\1", 0x0409: b"\0\x32", 0x020A: b"HP      12345   \0\0"}
    raw = spark.createDataFrame([("t1", k, v) for k, v in attributes.items()], "cartridge string, command int, data binary")
    r = cartridge.attribute_report(raw).first()
    assert (r["free_percent"], r["generation"], r["native_gb"], r["load_count"], r["manufacturer"]) == ("98", "LTO-2", 200, 42, "FAKMANUF")
    assert round(float(r["fve"]), 2) == 0.09 and r["type_name"] == "Cleaning cartridge (50 cycles max)" and r["device_0"]["serial"] == "12345" and r["barcode"] is None
    assert one(spark, cartridge.free_percent(F.lit(1), F.lit(0))) == "?" and one(spark, cartridge.hours_minutes(F.lit(83))) == "1h23"
    assert round(one(spark, cartridge.seconds_per_pass(F.lit(83), F.lit(4), F.lit(16)))) == 78 and one(spark, cartridge.total_tracks(F.lit(4), F.lit(16), F.lit(8))) == 512
