"""Export and import of the catalog as one JSON document."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from shelfline import schema

KEYS = {"file": "files", "tape": "tapes", "position": "positions"}
SCHEMAS = {"file": schema.FILE, "tape": schema.TAPE, "position": schema.POSITION}


def kinds(names: Iterable[str] = ("file", "tape", "position")) -> list[str]:
    """Known kinds among the names, whatever their case, each once; none at all is an error."""
    chosen = [k for k in dict.fromkeys(n.strip().lower() for n in names) if k in KEYS]
    if not chosen:
        raise ValueError("nothing to export")
    return chosen


def _omit_zero(column: Column, kind) -> Column:
    """Zero values are left out of a document, times never."""
    if isinstance(kind, LongType):
        return F.nullif(column, F.lit(0))
    if isinstance(kind, StringType):
        return F.nullif(column, F.lit(""))
    if isinstance(kind, BinaryType):
        return F.when(F.length(column) > 0, F.base64(column))
    return column


def export_rows(tables: dict[str, DataFrame], names: Iterable[str] = ("file", "tape", "position")) -> DataFrame:
    """``(kind, id, json)``: the document's rows, one a line, for catalogs of any size. Rows with id 0 don't exist."""
    out = None
    for kind in kinds(names):
        df = tables[kind].where("id <> 0")
        fields = [_omit_zero(F.col(f.name), SCHEMAS[kind][f.name].dataType).alias(f.name) for f in SCHEMAS[kind]]
        rows = df.select(F.lit(kind).alias("kind"), "id", F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"}).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def export_document(tables: dict[str, DataFrame], names: Iterable[str] = ("file", "tape", "position")) -> DataFrame:
    """``(json)``: one row with the whole document, in order of ids. It gathers the catalog, so it is for small ones; see export_rows."""
    rows = export_rows(tables, names)
    part = lambda kind: F.concat(F.lit(f'"{KEYS[kind]}":['), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("id", "json")))), lambda r: r["json"]), ","), F.lit("]"))
    return rows.agg(F.concat(F.lit("{"), F.concat_ws(",", *[part(k) for k in kinds(names)]), F.lit("}")).alias("json"))


def write_document(tables: dict[str, DataFrame], path: str, names: Iterable[str] = ("file", "tape", "position")) -> None:
    """The whole document, in order of ids, as text files that make it up one after the other; for catalogs of any size.

    Rows are sorted by ranges over all tasks; each kind's first row follows its key, the others a comma."""
    rows, order = export_rows(tables, names), kinds(names)
    place = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate(order) for x in (kind, k)]), F.col("kind"))
    first = rows.groupBy("kind").agg(F.min("id").alias("_first"))  # a row a kind
    body = rows.join(F.broadcast(first), "kind").select(place.alias("k"), F.lit(1).alias("part"), "id", F.concat(F.when(F.col("id") == F.col("_first"), "").otherwise(","), F.col("json")).alias("value"))
    frame = [(k, part, 0, text) for k, kind in enumerate(order) for part, text in ((0, ("{" if k == 0 else ",") + f'"{KEYS[kind]}":['), (2, "]" + ("}" if k == len(order) - 1 else "")))]
    body.unionByName(rows.sparkSession.createDataFrame(frame, "k int, part int, id long, value string")).orderBy("k", "part", "id").select("value").write.text(path)


def import_rows(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of rows ``(kind, json)`` such as export_rows gives: line by line, so for catalogs of any size."""
    return {kind: _restored(rows.where(F.col("kind") == kind).select(F.from_json("json", _text_schema(kind)).alias("r")).select("r.*"), kind) for kind in SCHEMAS if not rows.where(F.col("kind") == kind).isEmpty()}


def _text_schema(kind: str) -> StructType:
    return StructType([f if not isinstance(f.dataType, BinaryType) else type(f)(f.name, StringType()) for f in SCHEMAS[kind]])


def _restored(rows: DataFrame, kind: str) -> DataFrame:
    """Missing fields are 0, empty or null by their type; bytes come from base64."""
    fields = []
    for f in SCHEMAS[kind]:
        c = F.col(f.name)
        if isinstance(f.dataType, LongType):
            c = F.coalesce(c, F.lit(0).cast("long"))
        elif isinstance(f.dataType, StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, BinaryType):
            c = F.unbase64(c)
        fields.append(c.alias(f.name))
    return rows.select(*fields)


def import_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that a document has; missing fields are 0, empty or null by their type. Each replaces its table."""
    doc = StructType()
    for kind, key in KEYS.items():
        doc.add(key, ArrayType(_text_schema(kind)))
    raw = spark.read.schema(doc).json(path, multiLine=True)
    return {kind: _restored(raw.select(F.inline(key)), kind) for kind, key in KEYS.items() if not raw.where(F.col(key).isNotNull()).isEmpty()}
