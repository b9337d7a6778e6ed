"""Folders: where intermediate and written files go, and how large an input is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share; in local mode a temporary one if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="longpath-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/longpath-reads/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written_clean(df: DataFrame, folder: str) -> None:
    """Writes df to a folder as Parquet, beside what is there. The shuffle files of the write go once it has ended."""
    spark = df.sparkSession
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors. The shuffle files of the write go once it has ended."""
    folder = shared_folder(df.sparkSession, tag)
    written_clean(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder; results that read it have to be written before."""
    delete(spark, shared_folder(spark, "x").rsplit("/", 1)[0])


def drop_stored(*tables: DataFrame) -> None:
    """Deletes what stored() wrote for these tables, once nothing reads them any more."""
    for df in tables:
        marker = f"/longpath-reads/{df.sparkSession.sparkContext.applicationId}/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if marker in f}:
            delete(df.sparkSession, folder)


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(found).getLength()


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none if it is not there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(found)] if files.exists(found) else []
