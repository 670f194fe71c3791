"""A log of events that is compacted, and of which what the compaction covers is retired.

Events lie in folders by device and range of sequence numbers. A compaction writes a new version: first ``tail``, the events that later ones may still
depend on, a bounded number for each card, then ``vector``, each device's greatest number; the vector's end makes it count. Only then are folders whose whole range
the vector covers deleted. Readers take the newest finished version and the events above its vector, so that a crash between any two steps changes nothing that is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.replay import CARD, LONG_HISTORY, ORDER, live_reviews
from ..storage import committed, delete, folders
from .tables import EVENTS, read_versioned, versioned

#: Sequence numbers of a device in one folder.
RANGE = 100_000
#: Answers of a card that undo can still take back after a compaction.
KEPT = 64


def append_log(events: DataFrame, path: str, size: int = RANGE) -> None:
    """Add events; a folder's name has the number that its range ends before. Each is written by one task, of ``size`` rows at most."""
    rows = versioned(events).withColumn("seq_below", (F.floor(F.col("seq") / size) + 1) * size)
    rows.repartition("device_id", "seq_below").write.partitionBy("device_id", "seq_below").mode("append").parquet(f"{path}/events")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """What stands for the whole log: the newest tail, and the events above its vector."""
    rest = _events(spark, path)
    versions = committed(spark, f"{path}/vectors", "version")
    if not versions:
        return rest
    vector = read_versioned(spark, f"{path}/vectors/version={versions[-1]}").withColumnRenamed("seq", "covered")
    tail = read_versioned(spark, f"{path}/tails/version={versions[-1]}")
    return tail.unionByName(rest.join(vector, "device_id", "left").where("seq > coalesce(covered, -1)").drop("covered"))


def _events(spark: SparkSession, path: str) -> DataFrame:
    """Events of folders that are not retired; the folders' upper bounds prune what a vector covers."""
    if not folders(spark, f"{path}/events"):
        return spark.createDataFrame([], EVENTS)
    found = spark.read.schema(f"{EVENTS}, schema_version int, seq_below long").parquet(f"{path}/events")
    return found.drop("schema_version", "seq_below")


def essential(events: DataFrame, kept: int = KEPT, long: int = LONG_HISTORY) -> DataFrame:
    """The events that decide a card's state now and after up to ``kept`` more undos: its last live reviews, and its last event of another kind.

    Undone reviews and their undos are gone, so an undo whose time lies before one that is gone comes too late for it, as it does where a log is cut off.
    """
    last = Window.partitionBy(*CARD).orderBy(*[F.desc(c) for c in ORDER])
    of = lambda rows, n: rows.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= n).drop("_k")
    return of(live_reviews(events, long), kept).unionByName(of(events.where(~F.col("type").isin("review", "undo")), 1))


def compact_log(spark: SparkSession, path: str, kept: int = KEPT, long: int = LONG_HISTORY) -> int:
    """Write the next version from the newest one and the events above it, and return its number. Nothing is deleted.

    A version that was begun and not finished is written again.
    """
    versions = committed(spark, f"{path}/vectors", "version")
    number = versions[-1] + 1 if versions else 1
    vector = _events(spark, path).select("device_id", "seq")
    if versions:
        vector = vector.unionByName(read_versioned(spark, f"{path}/vectors/version={versions[-1]}").select("device_id", "seq"))
    versioned(essential(read_log(spark, path), kept, long)).write.mode("overwrite").parquet(f"{path}/tails/version={number}")
    versioned(vector.groupBy("device_id").agg(F.max("seq").alias("seq"))).write.mode("overwrite").parquet(f"{path}/vectors/version={number}")
    return number


def retire_log(spark: SparkSession, path: str) -> int:
    """Delete the folders of events that the newest finished version covers, and older versions; returns how many folders of events went. Names of folders alone are looked at here."""
    versions = committed(spark, f"{path}/vectors", "version")
    if not versions:
        return 0
    names = [(device, below) for device in folders(spark, f"{path}/events") for below in folders(spark, f"{path}/events/{device}")]
    gone = 0
    if names:
        vector = read_versioned(spark, f"{path}/vectors/version={versions[-1]}").select(F.concat(F.lit("device_id="), F.col("device_id").cast("string")).alias("device"), F.col("seq").alias("covered"))
        known = spark.createDataFrame(names, "device string, below string").withColumn("end", F.substring_index("below", "=", -1).cast("long"))
        for r in known.join(vector, "device").where("end - 1 <= covered").toLocalIterator():
            delete(spark, f"{path}/events/{r['device']}/{r['below']}")
            gone += 1
    for n in versions[:-1]:
        delete(spark, f"{path}/vectors/version={n}")
        delete(spark, f"{path}/tails/version={n}")
    return gone
