"""The session settings that results depend on, and those that help at scale."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Zone-less event times are read as UTC; adaptive execution splits skewed joins and sizes shuffles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build(master: str | None = None, **more: str) -> SparkSession:
    """A session with the fixed settings; ``more`` adds others, with ``_`` for ``.`` in their names."""
    builder = SparkSession.builder.appName("lexiflow").config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
