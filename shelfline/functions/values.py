"""Signatures, binary fields, times and display formats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, MapType

#: First byte of a content signature, for its version.
SIGNATURE_VERSION = 1


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def unhex_or_null(text: Column) -> Column:
    """Null where the text is no hex of whole bytes."""
    return F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))


def big_endian(number: Column, width: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(number), 2 * width, "0"))


def signature(sha256: Column, size: Column) -> Column:
    """Version, hash and big-endian size: equal contents have equal signatures."""
    return F.concat(F.unhex(F.lit(f"{SIGNATURE_VERSION:02x}")), sha256, big_endian(size))


def unsigned(data: Column) -> Column:
    """Big-endian bytes as a number of up to 64 unsigned bits."""
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")


def lossy_text(data: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes a replacement character instead of an error."""
    return F.make_valid_utf8(data.cast("string"))


def ascii_text(data: Column) -> Column:
    return F.rtrim(lossy_text(data))


def vendor_serial(data: Column) -> Column:
    """A vendor of 8 characters and the serial after it, both without spaces and NULs at their ends."""
    text = lossy_text(data)
    part = lambda x: F.btrim(x, F.lit(" \0"))
    return F.struct(part(F.substring(text, 1, 8)).alias("vendor"), part(F.substring(text, 9, 1 << 20)).alias("serial"))


def inquiry(data: Column) -> Column:
    """Vendor, model and firmware at their fixed places of a drive's reply."""
    field = lambda at, n: F.btrim(lossy_text(F.substring(data, at + 1, n)), F.lit(" \0"))
    return F.struct(field(8, 8).alias("vendor"), field(16, 16).alias("model"), field(32, 4).alias("firmware"))


def to_seconds(t: Column) -> Column:
    return F.unix_seconds(t.cast("timestamp"))


def to_nanos(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) * 1000


def from_nanos(ns: Column) -> Column:
    return F.timestamp_micros(F.floor(ns / 1000))


def rfc3339(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXXX")


def barcode(text: Column) -> Column:
    """The first six characters in upper case."""
    return F.upper(F.substring(text, 1, 6))


def json_barcode(text: Column) -> Column:
    return barcode(F.get_json_object(text, "$.barcode"))


def file_size(n: Column) -> Column:
    """Base 1024 with JEDEC unit names, at most two decimals."""
    units = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]
    out = F.lit(None).cast("string")
    for k in range(len(units) - 1, -1, -1):
        value = F.round(n / F.lit(float(1024**k)), 2)
        text = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
        out = F.when(n < 1024 ** (k + 1), F.concat(text, F.lit(f" {units[k]}"))).otherwise(out) if k < len(units) - 1 else F.concat(text, F.lit(f" {units[k]}"))
    return F.when(n.isNotNull(), out)


def progress(done: Column, total: Column) -> Column:
    """Percent done; 100 where there is nothing to do."""
    return F.when(total > 0, done * F.lit(100.0) / total).otherwise(F.lit(100.0))


def eta_seconds(left: Column, speed: Column) -> Column:
    return F.when(speed > 0, F.ceil(left / speed))


@F.pandas_udf(MapType(IntegerType(), BinaryType()))
def log_page(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Parameters of a log page: a head of four bytes that ends with the page's length, then code (2 bytes), control, length and value of each; null where a length runs over the end.

    A pandas UDF, since each field's place depends on the lengths before it."""
    for series in pages:
        out = []
        for page in series:
            found: dict[int, bytes] | None = {}
            at = 4
            size = int.from_bytes(page[2:4], "big") if page is not None else 0
            while at < size:
                n = page[at + 3] if at + 4 <= len(page) else None
                if n is None or at + 4 + n > len(page):
                    found = None
                    break
                found[int.from_bytes(page[at : at + 2], "big")] = bytes(page[at + 4 : at + 4 + n])
                at += 4 + n
            out.append(None if page is None else found)
        yield pd.Series(out, dtype=object)
