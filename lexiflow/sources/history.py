"""The audit history: numbered chunks that appends fill up, and the image of the card that each event shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lexicon import numbered
from ..operators.replay import CARD, LONG_HISTORY, ORDER, with_depth
from ..storage import committed
from .tables import CHUNK, read_versioned, versioned

#: What an image has of a card.
IMAGE = ["state", "step", "stability", "difficulty", "reps", "lapses", "flags", "due_ts", "last_review"]


def append_chunks(events: DataFrame, path: str, batch_id: int, size: int = CHUNK) -> None:
    """Add a batch of events to each learner's history: it goes on in the newest chunk, and begins another whenever one has ``size`` events.

    For ``foreachBatch`` as well: a batch that comes again is written again, to the same places. Each batch is a folder, followed by one with the number of events of every
    learner so far, whose end makes the batch count. Events are numbered in even ranges, so a learner with most of them is dealt over many tasks.
    """
    spark = events.sparkSession
    order = ["learner_id", *ORDER]
    put = numbered(events, order, "_at")
    first = put.groupBy("learner_id").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_more"))
    earlier = [n for n in committed(spark, f"{path}/totals", "batch") if n < batch_id]
    before = spark.createDataFrame([], "learner_id long, n long") if not earlier else read_versioned(spark, _place(path, "totals", earlier[-1]))
    starts = first.join(before, "learner_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.col("_at") - F.col("_first") + F.col("n")
    rows = put.join(starts, "learner_id").withColumn("chunk", F.floor(place / size).cast("int")).withColumn("place", (place % size).cast("int"))
    versioned(rows.select(*events.columns, "chunk", "place")).repartitionByRange("learner_id", "chunk").sortWithinPartitions("learner_id", "chunk", "place").write.mode("overwrite").parquet(_place(path, "events", batch_id))
    totals = before.join(first, "learner_id", "full").select("learner_id", (F.coalesce("n", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("n"))
    versioned(totals).write.mode("overwrite").parquet(_place(path, "totals", batch_id))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The events of all batches that count, with the number of their chunk and their place in it, both from 0."""
    found = [_place(path, "events", n) for n in committed(spark, f"{path}/totals", "batch")]
    if not found:
        raise FileNotFoundError(f"no history in {path}")
    return spark.read.parquet(*found).drop("schema_version")


def _place(path: str, kind: str, batch: int) -> str:
    return f"{path}/{kind}/batch={batch:09d}"


def history_images(events: DataFrame, long: int = LONG_HISTORY) -> DataFrame:
    """(card, order, kind, rating, image of the card) for a log whose events carry after images.

    An added, answered or unsuspended card (``update``) shows its image after the event, a removed or suspended one that before it, and an undo the one that it brings back. A card
    that is gone, or never was there, has none.

    The card's image as of an event is that of its last event by then that no undo has taken back by then. Among reviews this is the last one of the same
    depth (reviews less undos): a card comes to a depth by a review, or back to it by an undo that leaves this review on top. So it is a running value over (card, depth),
    and no stack is kept.
    """
    own = F.struct(*ORDER, "type", *IMAGE)
    card = Window.partitionBy(*CARD).orderBy(*ORDER)
    so_far = card.rowsBetween(Window.unboundedPreceding, 0)
    of_depth = Window.partitionBy(*CARD, "depth").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = with_depth(events, long)
    rows = rows.withColumn("_top", F.last(F.when(F.col("type") == "review", own), ignorenulls=True).over(of_depth))
    rows = rows.withColumn("_other", F.last(F.when(~F.col("type").isin("review", "undo"), own), ignorenulls=True).over(so_far))
    rows = rows.withColumn("_now", F.greatest("_top", "_other")).withColumn("_was", F.lag("_now").over(card))
    shown = F.when(F.col("type").isin("remove", "suspend"), F.col("_was")).when(F.col("type") == "undo", F.col("_now")).otherwise(own)
    kind = F.when(F.col("type") == "review", "answer").when(F.col("type") == "update", "unsuspend").otherwise(F.col("type"))
    rows = rows.select(*CARD, *ORDER, kind.alias("kind"), "rating", shown.alias("_image"))
    there = F.col("_image.type") != "remove"
    return rows.select(*CARD, *ORDER, "kind", "rating", *[F.when(there, F.col(f"_image.{c}")).alias(c) for c in IMAGE])
