"""Event logs of many devices: merge, last writer wins, rebuild, snapshots, deltas, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scheduling as S
from ..functions.scheduling import Parameters
from .lexicon import numbered
from .replay import CARD, ORDER, live_reviews

ID = ["device_id", "seq"]


def unseen(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote events that the local log lacks, each once."""
    return remote.dropDuplicates(ID).join(local.select(*ID), ID, "left_anti").select(*remote.columns)


def union_logs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Both logs without repeats; commutative, associative and idempotent."""
    return local.unionByName(remote).dropDuplicates(ID)


def effective(events: DataFrame) -> DataFrame:
    """Events that count: no undo, and no review that an undo cancels."""
    others = events.where(~F.col("type").isin("review", "undo"))
    return live_reviews(events).select(*events.columns).unionByName(others)


def winners(events: DataFrame) -> DataFrame:
    """The last event of each card by (ts, device, seq); one struct maximum, combined before the shuffle."""
    rest = [c for c in events.columns if c not in CARD]
    return events.groupBy(*CARD).agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("w")).select(*CARD, "w.*")


def rebuild(events: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Card states from a log whose events carry after images: the last effective event wins; removed cards are gone."""
    last = winners(effective(events)).where("type <> 'remove'")
    return last.withColumn("due_day", S.logical_day(F.col("due_ts"), p)).withColumnRenamed("ts", "winning_timestamp").drop(*ID, "type", "rating")


def upsert(cards: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Snapshot rows replace or create cards."""
    rest = [c for c in cards.columns if c not in CARD]
    old, new = cards.select(*CARD, F.struct(*rest).alias("old")), snapshot.select(*CARD, F.struct(*rest).alias("new"))
    return old.join(new, CARD, "full").select(*CARD, F.coalesce("new", "old").alias("c")).select(*CARD, "c.*")


def load(saved: DataFrame, snapshot: DataFrame, events: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Saved deck, then snapshot, then log: later ones replace earlier ones card by card, and removals in the log take effect."""
    rest = [c for c in saved.columns if c not in CARD]
    last = winners(effective(events)).withColumn("due_day", S.logical_day(F.col("due_ts"), p))
    gone = last.where("type = 'remove'").select(*CARD)
    kept = upsert(saved, snapshot).join(gone, CARD, "left_anti")
    return upsert(kept, last.where("type <> 'remove'").select(*CARD, *rest))


def version_vector(events: DataFrame) -> DataFrame:
    return events.groupBy("device_id").agg(F.max("seq").alias("seq"))


def next_sequence(events: DataFrame, snapshot_vector: DataFrame | None = None) -> DataFrame:
    """One above each device's greatest seq in snapshot and log."""
    both = events.select(*ID) if snapshot_vector is None else events.select(*ID).unionByName(snapshot_vector.select(*ID))
    return both.groupBy("device_id").agg((F.max("seq") + 1).alias("next_seq"))


def touched(events: DataFrame) -> DataFrame:
    return effective(events).select(*CARD).distinct()


def last_event(events: DataFrame) -> DataFrame:
    return effective(events).groupBy(*CARD).agg(F.max("ts").alias("winning_timestamp"))


def delta(events: DataFrame, marks: DataFrame, most: int | None = None) -> DataFrame:
    """Events above each device's mark (device_id, seq); with ``most``, the first that many of each device."""
    above = events.join(marks.select("device_id", F.col("seq").alias("mark")), "device_id", "left").where("seq > coalesce(mark, -1)").drop("mark")
    if most is None:
        return above
    return above.withColumn("k", F.row_number().over(Window.partitionBy("device_id").orderBy("seq"))).where(F.col("k") <= most).drop("k")


def record(before: DataFrame, after: DataFrame, kind: str, device: int, first_seq: int, ts: int) -> DataFrame:
    """Events with after images for the cards that a command changed, numbered from ``first_seq`` in the order of the cards."""
    rest = [c for c in after.columns if c not in CARD]
    changed = after.join(before.select(*CARD, F.struct(*rest).alias("was")), CARD, "left").where(F.col("was").isNull() | ~F.col("was").eqNullSafe(F.struct(*rest)))
    rows = numbered(changed.drop("was"), CARD, "k")
    return rows.select(F.lit(device).cast("decimal(20,0)").alias("device_id"), (F.col("k") + first_seq).alias("seq"), F.lit(ts).cast("long").alias("ts"), F.lit(kind).alias("type"), F.lit(None).cast("int").alias("rating"), *CARD, *rest)


def compact(events: DataFrame, p: Parameters = Parameters()) -> tuple[DataFrame, DataFrame]:
    """(snapshot, version vector): what replaces the log; events up to the vector may go once both are written."""
    return rebuild(events, p), version_vector(events)
