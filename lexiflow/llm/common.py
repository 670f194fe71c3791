"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, freed  # noqa: F401

#: The white space that the contracts name: space and the five control characters U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster, and has to. Only where that is unset and all runs on one machine, as in
    tests, is a temporary folder taken, and remembered in the session for later calls.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        named = named or tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    return staged_all([df], name)


def staged_all(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """One table of all ``parts``, written one after another. What one of them shuffles is deleted before the next, so disk follows the largest."""
    path = schema = None
    for df in parts:
        spark, schema = df.sparkSession, schema or df.schema
        path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        with freed(spark):
            df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let a batch on its way to Python have at most so many rows, since whole texts are in it; a smaller setting stands.

    This is a setting of the session and stays; it bounds memory of later queries as well and changes no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


#: The one model that a Python worker holds, by its key.
_model: dict[Hashable, object] = {}


def held_model(key: Hashable, make: Callable[[], object]) -> object:
    """The model for ``key``; a worker lives on through other stages, so that of another operator goes first."""
    if key not in _model:
        _model.clear()
        _model[key] = make()
    return _model[key]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for a task that needs no model: those of earlier stages go before it, and what it freed goes back to the system after it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        yield from run(batches)
        _give_back()

    return whole


def _give_back() -> None:
    _model.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def with_python(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], new: list[T.StructField]) -> DataFrame:
    """``df`` through ``run``, which adds the columns ``new`` at the end of each batch. In ``run`` columns are known by place, so no name is in the way."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    added = [T.StructField(f"n{k}", f.dataType) for k, f in enumerate(new)]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    names = [*plain.columns, *(f.name for f in added)]
    return plain.mapInArrow(named, T.StructType([*plain.schema.fields, *added])).toDF(*df.columns, *(f.name for f in new))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
