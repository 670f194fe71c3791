"""The folder that the machines of a cluster share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and all runs on one machine, as in tests, a temporary folder, remembered in the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        named = named or tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether the shuffle files of a query are deleted when it ends; without it they stay until the driver collects garbage, however long that takes.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind, so the disk that a job needs is that of its largest step and not of their sum. The setting is put back."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends there, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, of any store that Spark writes to; none if it is not there."""
    at = _at(spark, path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(x.getPath().getName()) for x in fs.listStatus(at) if x.isDirectory()) if fs.exists(at) else []


def committed(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers n of the folders ``key=n`` that a writer has finished, in order."""
    fs = _at(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x for x in folders(spark, path) if x.startswith(f"{key}=")]
    return sorted(int(x.removeprefix(f"{key}=")) for x in found if fs.exists(_at(spark, f"{path}/{x}/_SUCCESS")))


def delete(spark: SparkSession, path: str) -> None:
    at = _at(spark, path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the folder of a :func:`staged` table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        delete(df.sparkSession, files[0].rsplit("/", 1)[0])
