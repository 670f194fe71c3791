"""Review events as a stream: deduplication, last writer wins, card state, activity, audit log."""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scheduling import Parameters
from ..operators import sync
from ..operators.fold import UNDO_DEPTH, Card, Ledger
from ..operators.replay import CARD, FIELDS, ORDER, STATE
from ..sources.tables import lacking

#: How late an event may come before deduplication and activity no longer count it.
LATENESS = "7 days"


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_seconds("ts"))


def deduplicated(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each (device, seq) once, with state that the watermark bounds; events behind the watermark are dropped."""
    return with_time(events).withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["device_id", "seq"])


def daily_activity(events: DataFrame, p: Parameters = Parameters(), lateness: str = LATENESS) -> DataFrame:
    """(learner_id, deck, type, day window, n) by logical days; days that end before the watermark take no more events."""
    day = F.window("event_time", "1 day", startTime=f"{p.day_offset} seconds")
    return with_time(events).withWatermark("event_time", lateness).groupBy("learner_id", "deck", "type", day).agg(F.count(F.lit(1)).alias("n"))


#: Buckets of the table of winners. A batch rewrites those that its cards fall in.
BUCKETS = 64


def last_writer_sink(path: str, buckets: int = BUCKETS):
    """For ``foreachBatch``: keeps each card's winning event in a table of buckets by card, each with versions by batch.

    A batch is reduced to winners and merged by the same order with the buckets that its cards fall in, so late events lose by their
    time and repeated batches change nothing. Other buckets are not read. Of each bucket the version before the newest stays, in case that the
    batch is run again; older ones are deleted.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = sync.winners(batch.where("type <> 'undo'")).withColumn("bucket", F.pmod(F.xxhash64(*CARD), F.lit(buckets)).cast("int")).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
        versions = {k: sorted(v for v in found if v < batch_id) for k, found in _versions(spark, path).items() if k in touched}
        before = [_place(path, k, v[-1]) for k, v in versions.items() if v]
        merged = new
        if before:
            old = spark.read.schema(new.drop("bucket").schema).parquet(*before)
            again = sync.winners(old.unionByName(new.drop("bucket")))
            merged = again.withColumn("bucket", F.pmod(F.xxhash64(*CARD), F.lit(buckets)).cast("int"))
        merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")
        new.unpersist()
        for k, found in versions.items():
            for v in found[:-1]:
                _files(spark, path).delete(_at(spark, _place(path, k, v)), True)

    return run


def read_winners(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version of each bucket."""
    newest = [_place(path, k, max(found)) for k, found in _versions(spark, path).items()]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)


def _place(path: str, bucket: int, batch: int) -> str:
    return f"{path}/batch={batch:09d}/bucket={bucket}"


def _at(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _at(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """For each bucket, the complete batches that wrote it, by Spark's own file system."""
    fs, out = _files(spark, path), {}
    if not fs.exists(_at(spark, path)):
        return out
    for batch in fs.listStatus(_at(spark, path)):
        at = str(batch.getPath())
        if fs.exists(_at(spark, f"{at}/_SUCCESS")):
            for part in fs.listStatus(_at(spark, at)):
                name = part.getPath().getName()
                if name.startswith("bucket="):
                    out.setdefault(int(name.removeprefix("bucket=")), []).append(int(at.rsplit("batch=", 1)[1]))
    return out


SHOWN = [*CARD, *FIELDS, "lost", "waiting", "held"]


#: Buckets of the card states, fixed for the life of a checkpoint. ``buckets_for`` gives a number by the cards to expect.
CARD_BUCKETS, CARDS_A_BUCKET = 4096, 64


def buckets_for(cards: int) -> int:
    """As many buckets as it takes for ``CARDS_A_BUCKET`` cards in each."""
    return max(1, -(-cards // CARDS_A_BUCKET))


class CardState(StatefulProcessor):
    """Per card: its state as of the watermark, a bounded number of states before it for undo, and the events behind the watermark's back.

    An event waits until the watermark has passed it. Then no earlier one can come any more, and it is folded into the settled state in its
    order by (ts, device, seq); so a late event, or an undo that comes before its review, counts as if it had come in time. A timer at the last waiting event settles buckets
    that get no more rows. An undo that reaches deeper than ``depth`` settled answers marks the card ``lost``, for repair from the log.

    The grouping key is a bucket of cards, since a call and its trips to the state store cost milliseconds, whatever is in them. A bucket's cards are one value: by card its
    seed, state, deeper, lost, states before and waiting events in order, all plain tuples, pickled. Cards without new rows are carried over as they are.
    """

    def __init__(self, p: Parameters, depth: int = UNDO_DEPTH):
        self.p, self.depth = p, depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "cards binary, timer long")

    def _read(self) -> tuple[dict, int | None]:
        found = self.kept.get()
        return (pickle.loads(found[0]), found[1]) if found else ({}, None)

    def _write(self, cards: dict, timer: int | None) -> None:
        """One timer a bucket, at the last event that waits; ``timer`` is the one that is set."""
        last = max((c[-1][-1][0] * 1000 for c in cards.values() if c[-1]), default=None)
        if last != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if last is not None:
                self.handle.registerTimer(last)
        self.kept.update((pickle.dumps(cards, protocol=5), last))

    def _ledger(self, kept: tuple) -> Ledger:
        _, card, deeper, lost, before, _ = kept
        return Ledger(Card(*card), (Card(*c) for c in before), deeper, lost, self.depth)

    def _apply(self, ledger: Ledger, events: list[tuple], seed: int) -> None:
        for ts, _, _, kind, rating in events:
            if kind == "review":
                ledger.answer(rating, ts, self.p, seed)
            elif kind == "undo":
                ledger.undo()

    def _settle(self, cards: dict, watermark: int) -> None:
        """Fold what the watermark has passed, of all cards; the rest waits on."""
        for key, kept in cards.items():
            seed, waiting = kept[0], kept[-1]
            if waiting and waiting[0][0] * 1000 <= watermark:
                n = bisect_right(waiting, watermark, key=lambda e: e[0] * 1000)
                ledger = self._ledger(kept)
                self._apply(ledger, waiting[:n], seed)
                cards[key] = (seed, tuple(ledger.card), ledger.deeper, ledger.lost, [tuple(c) for c in ledger.before], waiting[n:])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cards, timer = self._read()
        new: dict = {}
        for part in rows:
            columns = [part[c].tolist() for c in (*CARD, "card_key", *ORDER, "type", "rating")]
            for learner, deck, card, seed, ts, device, seq, kind, rating in zip(*columns, strict=True):
                event = (ts, int(device), seq, kind, None if pd.isna(rating) else int(rating))
                new.setdefault((learner, deck, card), (seed, {}))[1][event[:3]] = event
        for card, (seed, events) in new.items():
            kept = cards.get(card) or (seed, tuple(Card()), 0, False, [], [])
            events = {e[:3]: e for e in kept[-1]} | events
            cards[card] = (*kept[:-1], [events[k] for k in sorted(events)])
        self._settle(cards, timerValues.getCurrentWatermarkInMs())
        self._write(cards, timer)
        shown = []
        for card, (seed, _) in new.items():
            now, held, left = self._ledger(cards[card]), len(cards[card][-2]), cards[card][-1]
            self._apply(now, left, seed)
            shown.append((*card, *now.card, now.lost, len(left), held))
        yield pd.DataFrame(shown, columns=SHOWN, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cards, _ = self._read()
        self._settle(cards, timerValues.getCurrentWatermarkInMs())
        self._write(cards, None)  # the timer that went off is deleted by Spark
        yield pd.DataFrame([], columns=SHOWN, dtype=object)  # the states that were shown last are still right

    def close(self) -> None:
        pass


def live_of(events: list[tuple]) -> list[tuple]:
    """Reviews of one card, in order, less those that an undo takes back."""
    live: list[tuple] = []
    for e in events:
        if e[3] == "review":
            live.append(e)
        elif e[3] == "undo" and live:
            live.pop()
    return live


def streaming_cards(events: DataFrame, p: Parameters = Parameters(), lateness: str = LATENESS, depth: int = UNDO_DEPTH, buckets: int = CARD_BUCKETS) -> DataFrame:
    """(learner_id, deck, card_id, state fields, lost, waiting, held), a row for each card that a batch has events of.

    Events may come as late as ``lateness``, in any order and more than once; later ones are dropped and counted by the stream's progress, for batch repair. The state of a card
    is bounded by its events within that time, which ``waiting`` counts, and ``depth`` states for undo, of which ``held`` are there. ``lost`` tells that an undo reached deeper.
    Cards are kept in ``buckets``, whose number has to stay the same as long as the checkpoint is used.
    """
    key = F.xxhash64(*CARD)
    bucket = F.pmod(key, F.lit(buckets)).alias("bucket")
    rows = with_time(events).withWatermark("event_time", lateness).select(bucket, *CARD, *ORDER, "type", "rating", key.alias("card_key"), "event_time")
    shown = f"learner_id long, deck string, card_id long, {STATE}, lost boolean, waiting int, held int"
    return rows.groupBy("bucket").transformWithStateInPandas(CardState(p, depth), outputStructType=shown, outputMode="Update", timeMode="EventTime")


def late_events(events: DataFrame, horizon: int) -> DataFrame:
    """(learner_id, n_late): events at or before a watermark in epoch seconds, which go to batch repair."""
    return events.groupBy("learner_id").agg(F.count_if(F.col("ts") <= horizon).alias("n_late"))


def sorting_sink(path: str):
    """For ``foreachBatch``: sound events go to ``events``, torn ones with what they lack to ``quarantine``, a folder for each batch, which a repeated batch writes again.

    Both come from one read of the batch, which is kept for the two writes.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("lacks", lacking(batch)).persist()
        try:
            rows.where("lacks is null").drop("lacks").write.mode("overwrite").parquet(f"{path}/events/batch={batch_id:09d}")
            rows.where("lacks is not null").write.mode("overwrite").parquet(f"{path}/quarantine/batch={batch_id:09d}")
        finally:
            rows.unpersist()

    return run


def dropped_rows(progress: list) -> int:
    """Rows that the watermark kept out of a stream's state, by the reports of its batches."""
    return sum(state["numRowsDroppedByWatermark"] for report in progress for state in report["stateOperators"])


def append_audit(events: DataFrame, path: str, checkpoint: str):
    """An append-only file sink in files of at most a thousand events."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", 1000).trigger(availableNow=True).start()
