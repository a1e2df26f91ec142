"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of sessions on this machine alone, by application.
_OWN: dict[str, str] = {}


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; without that setting a local session gets a temporary one, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _OWN[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str = "kept") -> DataFrame:
    """``df`` written to the shared folder and read again, so that nothing before it is done twice."""
    path = work_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def stamp(spark: SparkSession, path: str) -> tuple:
    """What changes when a file or folder of files does: bytes, number of files, time of the last change."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    held = files.getContentSummary(place)
    return held.getLength(), held.getFileCount(), files.getFileStatus(place).getModificationTime()
