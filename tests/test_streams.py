"""Sinks fed batch by batch: late and repeated batches, buckets, versions; decks written in parts; rows numbered in ranges."""

import os
from decimal import Decimal

from pyspark.sql import functions as F

from lexiflow.operators import lexicon, sync
from lexiflow.operators import replay as R
from lexiflow.sources import tables
from lexiflow.streaming import events as E

T0 = 1_700_000_000


def rows(spark, found):
    return spark.createDataFrame([(c % 3, "recog", c, 1, s, t, kind, 3) for c, s, t, kind in found], "learner_id long, deck string, card_id long, device_id int, seq long, ts long, type string, rating int").select(
        "learner_id", "deck", "card_id", F.col("device_id").cast("decimal(20,0)").alias("device_id"), "seq", "ts", "type", "rating"
    )


def state(spark, path, schema):
    return sorted(map(tuple, E.read_winners(spark, path, schema).collect()))


def test_late_and_repeated_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "winners")
    first = rows(spark, [(c, c, 1000 + c, "review") for c in range(40)])
    second = rows(spark, [(3, 100, 5000, "review"), (4, 101, 10, "review"), (5, 102, 9000, "undo"), (60, 103, 1, "review")])
    sink = E.last_writer_sink(path, buckets=8)
    assert state(spark, path, first.schema) == []
    sink(first, 0)
    assert state(spark, path, first.schema) == sorted(map(tuple, sync.winners(first).collect()))
    sink(second, 1)
    want = sorted(map(tuple, sync.winners(first.unionByName(second).where("type <> 'undo'")).collect()))
    assert state(spark, path, first.schema) == want
    assert {r[4] for r in want if r[2] in (3, 4)} == {100, 4}  # the later one wins, and the late one loses
    sink(second, 1)  # run again after a failure
    assert state(spark, path, first.schema) == want
    sink(first, 2)  # all of it once more
    assert state(spark, path, first.schema) == want


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "winners")
    sink = E.last_writer_sink(path, buckets=8)
    sink(rows(spark, [(c, c, 1000 + c, "review") for c in range(40)]), 0)
    for k in range(1, 5):
        sink(rows(spark, [(7, 1000 + k, 6000 + k, "review")]), k)
    folders = lambda k: sorted(x for x in os.listdir(f"{path}/batch={k:09d}") if x.startswith("bucket="))
    touched = folders(4)
    assert len(touched) == 1 and len(folders(0)) == 7  # of the touched bucket, the versions before the last but one are gone
    assert folders(3) == touched and folders(1) == folders(2) == []


def test_decks_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "DECK_PART", 3)
    decks = spark.createDataFrame([("a", "A", n) for n in range(20)] + [("b", "B", 5), ("", "none", 1)], "deck_id string, name string, ent_seq long")
    tables.write_custom_decks(decks, str(tmp_path / "decks"))
    back = tables.read_custom_decks(spark, str(tmp_path / "decks"), lines=True)
    assert sorted(map(tuple, back.collect())) == sorted([("a", "A", n) for n in range(20)] + [("b", "B", 5)])
    assert spark.read.json(str(tmp_path / "decks")).count() > 3
    (tmp_path / "one.json").write_text('[\n {"id": "x", "name": "X", "entSeqs": [1, 2]},\n {"id": "", "name": "?", "entSeqs": [3]}\n]')
    assert sorted(map(tuple, tables.read_custom_decks(spark, str(tmp_path / "one.json")).collect())) == [("x", "X", 1), ("x", "X", 2)]


def test_numbers_follow_the_order(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 100_003).alias("key"))
    got = [(r["key"], r["n"]) for r in lexicon.numbered(d, ["key"], "n").orderBy("key").collect()]
    assert got == [(k, i) for i, k in enumerate(sorted(i * 7919 % 100_003 for i in range(1000)))]
    assert lexicon.numbered(d.where("false"), ["key"], "n").count() == 0


def card_rows(spark, found):
    schema = "learner_id long, deck string, card_id long, device_id decimal(20,0), seq long, ts long, type string, rating int"
    return spark.createDataFrame([(1, "recog", c, Decimal(1), s, T0 + t, "undo" if r == 0 else "review", r or None) for c, s, t, r in found], schema)


def last_rows(spark, path, batches, **options):
    """Feed batches to the card stream one by one; (card, last row shown) after all of them."""
    shown = {}
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(batch, batch_id):
        for r in batch.collect():
            shown[r.card_id] = r

    try:
        for found in batches:
            rows = card_rows(spark, found)
            rows.coalesce(1).write.mode("append").parquet(f"{path}/in")
            stream = E.streaming_cards(E.event_stream(spark, f"{path}/in", rows.schema), **options)
            stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name)
    return shown


def test_card_state_is_bounded_and_late_events_count(spark, tmp_path):
    hour = 3600
    first = [(1, 0, 0, 3), (1, 1, 600, 3), (1, 3, 2 * hour, 4), (2, 4, 0, 3)]
    late = [(1, 2, hour, 1), (1, 2, hour, 1), (1, 6, 3 * hour, 0)]  # one in between, twice, and an undo
    later = [(1, 10 + k, (k + 2) * 86_400, 3) for k in range(12)]
    dropped = [(1, 50, 30, 1)]  # far behind the watermark
    shown = last_rows(spark, str(tmp_path), [first, late, later, dropped, [(3, 60, 40 * 86_400, 3)], [(1, 61, 41 * 86_400, 0)]], lateness="6 hours", depth=4)
    want = {r.card_id: r for r in R.replay(card_rows(spark, first + late[1:] + later + [(3, 60, 40 * 86_400, 3), (1, 61, 41 * 86_400, 0)])).collect()}
    for card in want:
        assert [round(shown[card][f], 9) for f in R.FIELDS] == [round(want[card][f], 9) for f in R.FIELDS]
    assert shown[1].held <= 4 and shown[1].waiting <= 1 and not shown[1].lost


def test_an_undo_too_deep_is_told(spark, tmp_path):
    answers = [(1, k, k * 86_400, 3) for k in range(6)]
    undos = [(1, 20 + k, (10 + k) * 86_400, 0) for k in range(4)]
    shown = last_rows(spark, str(tmp_path), [answers, [(2, 9, 8 * 86_400, 3)], undos], lateness="1 hour", depth=3)
    assert shown[1].lost and shown[1].held <= 3


def test_cards_share_a_bucket(spark, tmp_path):
    """Thirty cards in two buckets: two calls a batch, two values and two timers in the state, and each card as if it were alone."""
    day = 86_400
    first = [(c, c, c * 60, 1 + c % 4) for c in range(30)]
    some = [(c, 100 + c, 2 * day + c, 3) for c in range(0, 30, 3)]
    undone = [(5, 200, 3 * day, 0), (7, 201, 3 * day, 0), (7, 202, 3 * day + 1, 0)]
    far = [(6, 300, 30 * day, 4)]  # the others of its bucket are settled with it, those of the other one by a timer
    after = [(c, 400 + c, 31 * day + c, 2) for c in range(0, 30, 2)] + [(9, 500, 31 * day, 0)]
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shown, kept, path = {}, 0, str(tmp_path)

    def put(batch, batch_id):
        found = batch.collect()
        assert len({r.card_id for r in found}) == len(found)
        shown.update({r.card_id: r for r in found})

    try:
        for found in (first, some, undone, far, after):
            rows = card_rows(spark, found)
            rows.coalesce(1).write.mode("append").parquet(f"{path}/in")
            cards = E.streaming_cards(E.event_stream(spark, f"{path}/in", rows.schema), lateness="1 day", buckets=2)
            run = cards.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
            run.awaitTermination()
            kept = max(kept, *[s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]])
    finally:
        spark.conf.unset(name)
    want = {r.card_id: r for r in R.replay(card_rows(spark, first + some + undone + far + after)).collect()}
    assert set(want) == set(range(30)) - {5, 7} and set(shown) == set(range(30)) and shown[5].total_answers == shown[7].total_answers == 0  # all their answers are taken back
    for card in want:
        assert [round(shown[card][f], 9) for f in R.FIELDS] == [round(want[card][f], 9) for f in R.FIELDS]
    assert 0 < kept <= 6 and shown[2].waiting == 1 and shown[2].held == 1


def test_buckets_follow_the_cards():
    assert [E.buckets_for(n) for n in (0, 1, E.CARDS_A_BUCKET, E.CARDS_A_BUCKET + 1, 1_000_000)] == [1, 1, 1, 2, 15_625]
