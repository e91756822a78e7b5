"""Things that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a broadcast table that is cut to its largest groups; every group left out holds under 1/HOT_ROWS of all rows.
HOT_ROWS = 1000

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share. Where it is unset, a temporary one if all
    executors are in this process; else an error, as no other machine could read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="graphloom-")
    return _own_folder[app]


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again, which cuts its lineage and outlives lost executors.

    The shuffles behind it can't be reached any more then. Spark deletes their files when the driver's garbage is
    collected; a driver with room to spare may not do so for long, while executors' disks fill, so it is asked to.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.graphloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stash() gave, when nothing that reads them is still to be run."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.graphloom_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    """The cluster's own setting for shuffles, which grows with the data it is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
