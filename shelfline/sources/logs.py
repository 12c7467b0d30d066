"""Job logs and tape reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a log that one request returns at most; the next one goes on from there.
TAIL_BYTES = 1 << 20


def _whole_characters(data: bytes, end: bool) -> bytes:
    """Without a character at the end whose last bytes are still to come, unless nothing comes after."""
    for back in range(1, min(4, len(data)) + 1):
        lead = data[-back]
        if lead < 0x80 or end:
            break
        if lead >= 0xC0:
            return data[:-back] if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else data
    return data


def log_tail(spark: SparkSession, path: str, offset: int = 0, limit: int = TAIL_BYTES) -> DataFrame:
    """``(text, next_offset)``: at most ``limit`` bytes of a log from an offset on; nothing where that is at or beyond the end.

    A log is a file, or a folder of part files that count as one in order of their names. Only the bytes asked for are
    read. What is no UTF-8, such as the rest of a character that the offset lies in, becomes a replacement character; a
    character that the log or the limit cuts is left for the next request."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    parts = sorted(((f.getPath().getName(), f.getPath(), f.getLen()) for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=lambda x: x[0])
    total, start, data = sum(size for _, _, size in parts), 0, b""
    for _, file, size in parts:
        skip = max(0, offset - start)
        if skip < size and len(data) < limit:
            stream = fs.open(file)
            try:
                stream.seek(skip)
                data += bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size - skip, limit - len(data))))
            finally:
                stream.close()
        start += size
    data = _whole_characters(data, end=False)
    return spark.createDataFrame([(data.decode("utf-8", "replace"), max(offset, min(total, offset + len(data))))], "text string, next_offset long")


def write_report(report: DataFrame, root: str) -> None:
    """One file ``<barcode>.log`` of JSON lines for each tape; a report replaces the one before it, others stay.

    Each tape's lines are written by one task, since they are one file; the files are moved into place one by one."""
    spark = report.sparkSession
    jvm, fresh = spark._jvm, f"{root.rstrip('/')}/_report"
    report.repartition("barcode").write.mode("overwrite").partitionBy("barcode").json(fresh)
    at = jvm.org.apache.hadoop.fs.Path(fresh)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for folder in [f.getPath() for f in fs.listStatus(at) if f.isDirectory()]:
        barcode = folder.getName().removeprefix("barcode=")
        final = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{barcode}.log")
        (part,) = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
        fs.delete(final, False)
        if not fs.rename(part, final):
            raise OSError(f"the report of {barcode} could not be written")
    fs.delete(at, True)


def log_path(root: str, job_id: int) -> str:
    """Where ``append_log`` puts a job's lines and ``log_tail`` finds them."""
    return f"{root.rstrip('/')}/job_id={job_id}"


def append_log(lines: DataFrame, root: str) -> None:
    """Lines ``(job_id, line)`` added to each job's log, a folder of part files whose names follow the time."""
    spark = lines.sparkSession
    jvm, fresh = spark._jvm, f"{root.rstrip('/')}/_append"
    lines.select("job_id", F.col("line").alias("value")).coalesce(1).write.mode("overwrite").partitionBy("job_id").text(fresh)
    at = jvm.org.apache.hadoop.fs.Path(fresh)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for folder in [f.getPath() for f in fs.listStatus(at) if f.isDirectory()]:
        target = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{folder.getName()}")
        fs.mkdirs(target)
        have = len([f for f in fs.listStatus(target) if f.isFile()])
        for part in [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]:
            if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(target, f"{have:09d}.log")):
                raise OSError(f"the log of {folder.getName()} could not be extended")
            have += 1
    fs.delete(at, True)
