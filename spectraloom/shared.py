"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder made once."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            where = held.get()
        elif spark.sparkContext.master.startswith("local"):
            where = "file://" + tempfile.mkdtemp(prefix="spectraloom-")
            spark.sparkContext.setCheckpointDir(where)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where.rstrip("/")


def _tables(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Delete all that written() has made in this application; what is still read from it can no longer be."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and a lost executor loses nothing; options of the writer."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_system(uri: str):
    """(Arrow file system, path in it) of a file's name, or None if Arrow does not know its kind."""
    from urllib.parse import unquote

    import pyarrow as pa
    from pyarrow import fs

    try:
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), unquote("/" + uri.removeprefix("file:").lstrip("/"))
        return fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
