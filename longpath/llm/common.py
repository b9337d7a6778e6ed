"""Helpers shared by the corpus operators: stored intermediate tables and Arrow kernels."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset in local mode (tests) a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="longpath-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/longpath/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes all that stored() wrote in this application; results that read it have to be written before."""
    _delete(spark, _own_dir(spark))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors.

    The shuffle files of the write go once it has ended.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes what stored() wrote for these tables, once nothing reads them any more."""
    for df in tables:
        marker = f"{_own_dir(df.sparkSession)}/".split("://", 1)[-1]
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles() if marker in f}:
            _delete(df.sparkSession, top)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def schema_of(ddl: str | T.StructType) -> T.StructType:
    if isinstance(ddl, T.StructType):
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in ddl])
    return T.StructType.fromDDL(ddl)


def pieces(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """batch in slices whose texts hold about limit bytes together; a longer text is a slice of its own."""
    import numpy as np

    if not batch.num_rows:
        return
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)).astype("int64")
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on between stages, and what its allocators keep counts beside the heap of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def kernel(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str | T.StructType, text: str = "text", limit: int = 1 << 20) -> DataFrame:
    """df through a batch function that runs in the workers.

    make() is called once a task and returns the function, which maps a slice of rows (about limit bytes of text) to
    columns in the order of ddl; all memory it takes is bounded by limit and the longest text.
    """
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        out, f = arrow_schema(schema), make()
        for batch in batches:
            for part in pieces(batch, text, limit):
                columns = f(part)
                yield pa.RecordBatch.from_arrays([c.cast(x.type) if isinstance(c := columns[x.name], pa.Array) else pa.array(c, x.type) for x in out], schema=out)
        give_back()

    return df.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
