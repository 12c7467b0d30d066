"""Cartridge memory: generations, types and derived figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.values import ascii_text, unsigned, vendor_serial

# Density code, generation, native and compressed GB, native and compressed MB/s, minutes to fill,
# compression ratio, WORM, encryption, partitions, bands a tape, wraps a band, tracks a wrap.
GENERATIONS = [
    (0x40, "LTO-1", 100, 200, 20, 40, 83, "2:1", False, False, 1, 4, 12, 8),
    (0x42, "LTO-2", 200, 400, 40, 80, 83, "2:1", False, False, 1, 4, 16, 8),
    (0x44, "LTO-3", 400, 800, 80, 160, 83, "2:1", True, False, 1, 4, 11, 16),
    (0x46, "LTO-4", 800, 1600, 120, 240, 111, "2:1", True, True, 1, 4, 14, 16),
    (0x58, "LTO-5", 1500, 3000, 140, 280, 190, "2:1", True, True, 2, 4, 20, 16),
    (0x5A, "LTO-6", 2500, 6250, 160, 400, 260, "2.5:1", True, True, 4, 4, 34, 16),
    (0x5C, "LTO-7", 6000, 15000, 300, 750, 333, "2.5:1", True, True, 4, 4, 28, 32),
    (0x5D, "LTO-M8", 9000, 22500, 300, 750, 500, "2.5:1", False, True, 4, 4, 42, 32),
    (0x5E, "LTO-8", 12000, 30000, 360, 900, 556, "2.5:1", True, True, 4, 4, 52, 32),
    (0x60, "LTO-9", 18000, 45000, 400, 1000, 750, "2.5:1", True, True, 4, 0, 0, 32),
]
GENERATION_COLUMNS = "density int, generation string, native_gb int, compressed_gb int, native_mb_s int, compressed_mb_s int, fill_minutes int, ratio string, worm boolean, encryption boolean, partitions int, bands int, wraps int, tracks int"

# Attribute, code, and whether it is text.
ATTRIBUTES = {
    "remaining_mib": (0x0000, False),
    "maximum_mib": (0x0001, False),
    "load_count": (0x0003, False),
    "mam_space_left": (0x0004, False),
    "formatted_density": (0x0006, False),
    "written_mib": (0x0220, False),
    "read_mib": (0x0221, False),
    "session_written_mib": (0x0222, False),
    "session_read_mib": (0x0223, False),
    "manufacturer": (0x0400, True),
    "serial": (0x0401, True),
    "length_m": (0x0402, False),
    "width": (0x0403, False),
    "medium_density": (0x0405, False),
    "made_on": (0x0406, True),
    "mam_capacity": (0x0407, False),
    "medium_type": (0x0408, False),
    "type_info": (0x0409, False),
    "barcode": (0x0806, True),
}

# Codes of the last four devices, latest first.
DEVICES = [0x020A, 0x020B, 0x020C, 0x020D]


def generations(spark: SparkSession) -> DataFrame:
    """The ten known generations: a dimension small enough to broadcast."""
    return spark.createDataFrame(GENERATIONS, GENERATION_COLUMNS)


def with_generation(df: DataFrame, density: str) -> DataFrame:
    known = generations(df.sparkSession).withColumnRenamed("density", density)
    return df.join(F.broadcast(known), density, "left")


def medium_type(code: Column, info: Column) -> Column:
    # Type codes.
    return F.when(code == 0x00, "Data cartridge").when(code == 0x01, F.concat(F.lit("Cleaning cartridge ("), info.cast("string"), F.lit(" cycles max)"))).when(code == 0x80, "WORM (Write-once) cartridge").otherwise("Unknown")


def free_percent(remaining: Column, maximum: Column) -> Column:
    """Whole percent; ``?`` without a maximum."""
    return F.when(maximum > 0, F.floor(remaining * 100 / maximum).cast("string")).otherwise("?")


def full_volume_equivalents(written: Column, capacity: Column) -> Column:
    return F.when(capacity > 0, written / capacity)


def age_years(made: Column, now: Column) -> Column:
    """Of 365 days each."""
    return (F.unix_seconds(now) - F.unix_seconds(made)) / F.lit(3600.0 * 24 * 365)


def hours_minutes(minutes: Column) -> Column:
    """Minutes below an hour as such; then hours and the minutes left, without leading zeros."""
    return F.when(minutes < 60, F.format_string("%d min", minutes)).when(minutes >= 60, F.format_string("%dh%d", F.floor(minutes / 60), minutes % 60))


def seconds_per_pass(minutes: Column, bands: Column, wraps: Column) -> Column:
    """Of one end-to-end pass, if the tape fills in so many minutes."""
    return F.when(bands * wraps > 0, minutes * F.lit(60.0) / (bands * wraps))


def total_tracks(bands: Column, wraps: Column, tracks: Column) -> Column:
    return bands * wraps * tracks


def attribute_report(raw: DataFrame) -> DataFrame:
    """One row a cartridge from rows ``(cartridge, command int, data binary)``; an attribute that could not be read is null."""
    value = lambda code: F.max(F.when(F.col("command") == code, F.col("data")))
    fields = [(ascii_text(value(c)) if text else unsigned(value(c))).alias(name) for name, (c, text) in ATTRIBUTES.items()]
    devices = [vendor_serial(value(c)).alias(f"device_{i}") for i, c in enumerate(DEVICES)]
    report = raw.groupBy("cartridge").agg(*fields, *devices)
    report = with_generation(report.withColumn("density", F.col("medium_density").cast("int")), "density")
    return report.withColumns({
        "free_percent": free_percent(F.col("remaining_mib"), F.col("maximum_mib")),
        "fve": full_volume_equivalents(F.col("written_mib"), F.col("maximum_mib")),
        "read_fve": full_volume_equivalents(F.col("read_mib"), F.col("maximum_mib")),
        "session_fve": full_volume_equivalents(F.col("session_written_mib"), F.col("maximum_mib")),
        "session_read_fve": full_volume_equivalents(F.col("session_read_mib"), F.col("maximum_mib")),
        "fill_time": hours_minutes(F.col("fill_minutes")),
        "passes": F.col("bands") * F.col("wraps"),
        "pass_seconds": seconds_per_pass(F.col("fill_minutes"), F.col("bands"), F.col("wraps")),
        "tracks_in_all": total_tracks(F.col("bands"), F.col("wraps"), F.col("tracks")),
        "type_name": medium_type(F.col("medium_type"), F.col("type_info")),
    })
