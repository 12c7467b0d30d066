"""The catalog's data model: table schemas, enums and mode predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _table(fields: str) -> StructType:
    out = StructType()
    for field in fields.split(", "):
        out.add(*field.split())
    return out


FILE = _table("id long, parent_id long, name string, mode long, mod_time timestamp, hash binary, size long, signature binary")
POSITION = _table("id long, file_id long, tape_id long, path string, mode long, mod_time timestamp, write_time timestamp, size long, hash binary")
TAPE = _table("id long, barcode string, name string, encryption string, create_time timestamp, destroy_time timestamp, capacity_bytes long, writen_bytes long")
TAPE_FILE = _table("path string, size long, mode long, mod_time timestamp, write_time timestamp, hash binary")
SOURCE = "struct<base:string,path:array<string>>"
ARCHIVE_STATE = f"struct<step:int,sources:array<struct<source:{SOURCE},size:long,status:int,message:string>>>"
RESTORE_FILE = "struct<file_id:long,tape_id:long,position_id:long,status:int,size:long,hash:binary,tape_path:string,target_path:string>"
RESTORE_STATE = f"struct<step:int,tapes:array<struct<tape_id:long,barcode:string,status:int,files:array<{RESTORE_FILE}>>>>"
JOB = f"id long, status int, priority long, create_time_ns long, update_time_ns long, state struct<archive:{ARCHIVE_STATE},restore:{RESTORE_STATE}>"
PROGRESS = _table("job_id long, t timestamp, bytes long")

ROOT_ID, TRASH_ID, UNLINKED = 0, -1, 0

# Enums as they are stored.
JOB_STATUS = {"DRAFT": 0, "NOT_READY": 1, "PENDING": 2, "PROCESSING": 3, "COMPLETED": 4, "FAILED": 127, "DELETED": 255}
COPY_STATUS = {"DRAFT": 0, "PENDING": 1, "RUNNING": 2, "STAGED": 3, "SUBMITED": 4, "FAILED": 255}
JOB_STEP = {"PENDING": 0, "WAIT_FOR_TAPE": 1, "COPYING": 2, "FINISHED": 255}
ENTITY_TYPE = {"NONE": 0, "FILE": 1, "TAPE": 2, "POSITION": 3}

#: Statuses below this are shown.
VISIBLE_BELOW = 128

# Bits of a mode.
DIR_BIT = 0x80000000
IRREGULAR_BITS = 0x8F280000
PERMISSION_BITS = 0o777


def is_dir(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(DIR_BIT)) != 0


def is_regular(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(IRREGULAR_BITS)) == 0


def permission(mode: Column) -> Column:
    """Octal digits of the permission bits."""
    return F.lpad(F.conv(mode.bitwiseAND(F.lit(PERMISSION_BITS)).cast("string"), 10, 8), 3, "0")


def enum_name(value: Column, names: dict[str, int], default: str = "UNKNOWN") -> Column:
    table = F.create_map(*[F.lit(x) for name, number in names.items() for x in (number, name)])
    return F.coalesce(F.try_element_at(table, value.cast("int")), F.lit(default))


def enum_number(name: Column, names: dict[str, int], default: int = 0) -> Column:
    """Names are matched whatever their case."""
    table = F.create_map(*[F.lit(x) for key, number in names.items() for x in (key, number)])
    return F.coalesce(F.try_element_at(table, F.upper(name)), F.lit(default))
