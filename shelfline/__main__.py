"""Command line: ``python -m shelfline export CATALOG OUT`` and ``python -m shelfline cartridge ATTRIBUTES``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from shelfline.functions import cartridge
from shelfline.sources import catalog_json
from shelfline.sources.snapshots import Catalog


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="shelfline")
    commands = parser.add_subparsers(dest="command", required=True)
    export = commands.add_parser("export", help="write a catalog as one JSON document, in text parts")
    export.add_argument("catalog")
    export.add_argument("out")
    export.add_argument("--types", default="file,tape,position", help="kinds to write, separated by commas")
    report = commands.add_parser("cartridge", help="print a report of each cartridge")
    report.add_argument("attributes", help="Parquet rows (cartridge, command int, data binary)")
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.appName("shelfline").getOrCreate()
    if chosen.command == "export":
        catalog, names = Catalog(spark, chosen.catalog), chosen.types.split(",")
        tables = {kind: catalog.read(kind, catalog_json.SCHEMAS[kind]) for kind in catalog_json.kinds(names)}
        catalog_json.write_document(tables, chosen.out, names)
    else:
        cartridge.attribute_report(spark.read.parquet(chosen.attributes)).orderBy("cartridge").show(1000, truncate=False, vertical=True)


if __name__ == "__main__":
    main()
