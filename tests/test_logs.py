"""Logs that are compacted and retired, histories in chunks, images of cards, and the sink that sorts torn events out."""

import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import sync as Y
from lexiflow.sources import history as H
from lexiflow.sources import log as G
from lexiflow.sources import tables as T
from lexiflow.storage import committed
from lexiflow.streaming import events as E

T0 = 1_700_000_000


def log(spark, n, seed=1, kinds=("review", "review", "review", "update", "remove", "undo", "add", "suspend"), cards=12):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((1 + i % 2, "d", r.randint(1, cards), Decimal(i % 3), i, T0 + i * 50 + r.randint(0, 49), r.choice(kinds), 3, r.randint(0, 3), 0, i + 0.5, 2.5, 1, 0, 0, T0 + i, T0))
    return spark.createDataFrame(rows, T.EVENTS)


def states(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_retired_log_rebuilds_the_whole(spark, tmp_path):
    path, e = str(tmp_path / "log"), log(spark, 240)
    assert G.read_log(spark, path).count() == 0 and G.retire_log(spark, path) == 0
    whole = states(Y.rebuild(e))
    G.append_log(e.where("seq < 100"), path, size=20)
    assert states(Y.rebuild(G.read_log(spark, path))) == states(Y.rebuild(e.where("seq < 100")))
    assert G.compact_log(spark, path, long=5) == 1
    G.append_log(e.where("seq >= 100"), path, size=20)
    assert states(Y.rebuild(G.read_log(spark, path))) == whole  # nothing retired yet: a crash after the vector
    gone = G.retire_log(spark, path)
    assert gone == 13 and G.retire_log(spark, path) == 0  # two devices may still add to their last range
    assert states(Y.rebuild(G.read_log(spark, path))) == whole
    assert G.compact_log(spark, path) == 2 and G.retire_log(spark, path) > 0
    assert committed(spark, f"{path}/vectors", "version") == [2]
    assert states(Y.rebuild(G.read_log(spark, path))) == whole


@pytest.mark.parametrize("lost", ["vectors", "half a vector"])
def test_a_crash_before_the_vector_changes_nothing(spark, tmp_path, lost):
    path, e = str(tmp_path / "log"), log(spark, 90, seed=4)
    G.append_log(e, path, size=10)
    whole = states(Y.rebuild(e))
    G.compact_log(spark, path)
    os.remove(f"{path}/vectors/version=1/_SUCCESS")  # the job ended before its commit
    if lost == "vectors":
        os.rename(f"{path}/vectors", str(tmp_path / "elsewhere"))
    assert G.retire_log(spark, path) == 0
    assert states(Y.rebuild(G.read_log(spark, path))) == whole
    assert G.compact_log(spark, path) == 1 and G.retire_log(spark, path) > 0
    assert states(Y.rebuild(G.read_log(spark, path))) == whole


def test_a_tail_is_bounded_and_serves_later_undos(spark):
    r = random.Random(7)
    moves = ["review"] * 300 + ["undo"] * 40 + ["review"] * 5 + ["undo"] * 20
    rows = [(1, "d", 1, Decimal(0), i, T0 + i, k, 3, r.randint(0, 3), 0, i + 0.5, 2.5, 1, 0, 0, T0 + i, T0) for i, k in enumerate(moves)]
    e = spark.createDataFrame(rows, T.EVENTS)
    tail = G.essential(e.where("seq < 340"), kept=50)
    assert tail.count() == 50 and tail.where("type <> 'review'").count() == 0
    assert states(Y.rebuild(tail.unionByName(e.where("seq >= 340")))) == states(Y.rebuild(e))


def test_chunks_are_filled_across_appends(spark, tmp_path):
    path = str(tmp_path / "h")
    e = log(spark, 2100).withColumn("learner_id", F.lit(1).cast("long"))
    with pytest.raises(FileNotFoundError):
        H.read_chunks(spark, path)
    for k in range(3):
        H.append_chunks(e.where(f"seq div 700 = {k}"), path, k)
    sizes = {r.chunk: r.n for r in H.read_chunks(spark, path).groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: 1000, 1: 1000, 2: 100}
    before = sorted((r.seq, r.chunk, r.place) for r in H.read_chunks(spark, path).collect())
    assert before == [(i, i // 1000, i % 1000) for i in range(2100)]
    H.append_chunks(e.where("seq div 700 = 2"), path, 2)  # the last batch comes again
    assert sorted((r.seq, r.chunk, r.place) for r in H.read_chunks(spark, path).collect()) == before
    H.append_chunks(e.where("false"), path, 3)
    H.append_chunks(e.where("seq < 2").withColumn("learner_id", F.lit(2).cast("long")), path, 4)
    assert {(r.learner_id, r.chunk) for r in H.read_chunks(spark, path).collect()} == {(1, 0), (1, 1), (1, 2), (2, 0)}


def test_an_unfinished_append_does_not_count(spark, tmp_path):
    path, e = str(tmp_path / "h"), log(spark, 50)
    H.append_chunks(e.where("seq < 20"), path, 0)
    H.append_chunks(e.where("seq >= 20"), path, 1)
    os.remove(f"{path}/totals/batch=000000001/_SUCCESS")
    assert H.read_chunks(spark, path).count() == 20
    H.append_chunks(e.where("seq >= 20"), path, 1)
    assert H.read_chunks(spark, path).count() == 50


@pytest.mark.parametrize("long", [10_000, 5])
def test_images_against_a_stack(spark, long):
    e = log(spark, 700, seed=9, cards=9)
    rows = sorted(e.collect(), key=lambda r: (r.ts, r.device_id, r.seq))
    lists, want = {}, {}
    for r in rows:  # of each card, the events that count so far, in order
        mine = lists.setdefault((r.learner_id, r.card_id), [])
        shown = mine[-1] if mine else None
        if r.type == "undo":
            last = next((k for k in range(len(mine) - 1, -1, -1) if mine[k].type == "review"), None)
            if last is not None:
                del mine[last]
            shown = mine[-1] if mine else None
        else:
            mine.append(r)
            shown = shown if r.type in ("remove", "suspend") else r
        want[r.seq] = None if shown is None or shown.type == "remove" else (shown.state, shown.stability, shown.due_ts)
    got = {r.seq: (r.state, r.stability, r.due_ts) if r.state is not None else None for r in H.history_images(e, long).collect()}
    assert got == want and None in want.values()


def test_torn_events_are_put_aside_once(spark, tmp_path):
    e = log(spark, 60)
    torn = e.withColumn("device_id", F.when(F.col("seq") % 5 != 0, F.col("device_id"))).withColumn("type", F.when(F.col("seq") % 7 == 0, None).otherwise(F.col("type")))
    sink = E.sorting_sink(str(tmp_path / "s"))
    for k in (0, 1, 1):
        sink(torn.where(f"seq % 2 = {k}"), k)
    sound = {r.seq for r in spark.read.parquet(str(tmp_path / "s/events")).collect()}
    lacks = {r.seq: r.lacks for r in spark.read.parquet(str(tmp_path / "s/quarantine")).collect()}
    assert lacks == {i: "device" if i % 5 == 0 else "type" for i in range(60) if i % 5 == 0 or i % 7 == 0}
    assert sound == set(range(60)) - set(lacks)
    assert spark.read.parquet(str(tmp_path / "s/events")).count() == len(sound)
