"""Tables between the rounds of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below that of ``spark.checkpoint.dir``, which all executors share.

    Only where the session names none, as in tests on one machine, a temporary folder is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(spark, "_shelfline_stages", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark._shelfline_stages = tempfile.mkdtemp(prefix="shelfline-")
    return f"{folder.rstrip('/')}/stages-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written as a table to the shared folder and read again: computed once, and kept if executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of ids that a join takes to all executors at once, some 10 MB; more are shuffled, however small their files are.
FEW_IDS = 100_000


def meeting(few: DataFrame, n: int) -> DataFrame:
    """A side of ``n`` rows of a join: the rows decide between broadcast and merge, as a table's files can be a hundredth of its rows."""
    return F.broadcast(few) if n <= FEW_IDS else few.hint("merge")


def drop_stages(spark: SparkSession) -> None:
    """Removes all tables that this application has cut; DataFrames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
