"""Replay goldens, undo, previews, plans, and properties of merging and rebuilding."""

import random

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import scheduling as S
from lexiflow.functions.scheduling import Parameters
from lexiflow.operators import plan as N
from lexiflow.operators import replay as R
from lexiflow.operators import sync as Y
from lexiflow.streaming.events import live_of

EVENTS = "learner_id long, deck string, card_id long, device_id decimal(20,0), seq long, ts long, type string, rating int"
T0 = 1_700_000_000


def log(spark, moves):
    """One card; moves are (seconds, letter): R with a rating, or U."""
    from decimal import Decimal

    rows = [(1, "recog", 1, Decimal(0), i, T0 + at, "undo" if m == "U" else "review", None if m == "U" else int(m)) for i, (at, m) in enumerate(moves)]
    return spark.createDataFrame(rows, EVENTS)


def state(spark, moves, p=Parameters()):
    return R.replay(log(spark, moves), p).first()


def test_golden_replay(spark):
    day = 4 * S.DAY
    s = state(spark, [(0, "3")])
    assert (round(s.stability, 6), round(s.difficulty, 6), s.state, s.due_ts - T0) == (3.1262, 5.323278, S.LEARNING, 600)
    s = state(spark, [(0, "3"), (600, "3")])
    assert (round(s.stability, 6), round(s.difficulty, 6), s.state, s.due_day - (T0 + 600 - 14_400) // S.DAY) == (3.71812, 5.203609, S.REVIEW, 4)
    s = state(spark, [(0, "3"), (600, "3"), (600 + day, "3")])
    assert (round(s.stability, 6), round(s.difficulty, 6), s.reps) == (13.145211, 5.09099, 2)
    s = state(spark, [(0, "3"), (600, "3"), (600 + day, "1")])
    assert (round(s.stability, 6), round(s.difficulty, 6), s.state, s.lapses, s.due_ts - s.last_review) == (1.171211, 7.095721, S.RELEARNING, 1, 600)


def test_steps_may_be_empty(spark):
    p = Parameters(learning_steps=(), relearning_steps=(), leech_threshold=1)
    s = state(spark, [(0, "2")], p)
    assert s.state == S.REVIEW and s.reps == 1
    s = state(spark, [(0, "2"), (90_000, "1")], p)
    assert s.state == S.REVIEW and s.flags & S.FLAG_LEECH


@pytest.mark.parametrize(("moves", "kept"), [("34U", [0]), ("34UU", []), ("U3", [1]), ("3U4", [2]), ("3UU4U3", [5])])
def test_undo(spark, moves, kept):
    events = log(spark, [(i, m) for i, m in enumerate(moves)])
    assert sorted(r.seq for r in R.live_reviews(events).collect()) == kept


def test_undo_against_a_stack(spark):
    r = random.Random(2)
    from decimal import Decimal

    rows = [(1, "d", c, Decimal(r.randint(0, 2)), i, T0 + r.randint(0, 300), r.choice(["review", "review", "undo"]), 3) for i, c in enumerate(r.randint(1, 40) for _ in range(2000))]
    events = spark.createDataFrame(rows, EVENTS)
    want = set()
    for c in {x[2] for x in rows}:
        mine = sorted((x for x in rows if x[2] == c), key=lambda x: (x[5], x[3], x[4]))
        want |= {e[2] for e in live_of([(x[5], x[3], x[4], x[6], x[7]) for x in mine])}
    assert {x.seq for x in R.live_reviews(events).collect()} == want


def _images(spark, n=400, seed=1):
    from decimal import Decimal

    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["review", "review", "update", "remove", "undo", "add"])
        rows.append((1, "d", r.randint(1, 30), Decimal(r.randint(0, 2)), i, T0 + r.randint(0, 5000), kind, 3, r.randint(0, 3), 0, 1.5, 2.5, 1, 0, 0, T0 + i, T0))
    return spark.createDataFrame(rows, EVENTS + ", state int, step int, stability double, difficulty double, reps int, lapses int, flags int, due_ts long, last_review long")


def _set(df):
    return {tuple(r) for r in df.select(sorted(df.columns)).collect()}


def test_merge_properties(spark):
    e = _images(spark)
    a, b, c = e.where("seq % 3 < 2"), e.where("seq % 3 > 0"), e.where("seq % 5 = 0")
    assert _set(Y.union_logs(a, b)) == _set(Y.union_logs(b, a)) == _set(e)
    assert _set(Y.union_logs(Y.union_logs(a, b), c)) == _set(Y.union_logs(a, Y.union_logs(b, c)))
    assert _set(Y.union_logs(a, a)) == _set(a)
    assert _set(a.unionByName(Y.unseen(a, b))) == _set(e)
    assert _set(Y.rebuild(e)) == _set(Y.rebuild(e.orderBy(F.rand(3))))


def test_device_ids_are_unsigned(spark):
    from decimal import Decimal

    e = _images(spark, 2).withColumn("card_id", F.lit(1).cast("long")).withColumn("type", F.lit("update")).withColumn("ts", F.lit(T0).cast("long"))
    e = e.withColumn("device_id", F.when(F.col("seq") == 0, F.lit(Decimal(2**64 - 1))).otherwise(F.lit(Decimal(5))).cast("decimal(20,0)"))
    assert Y.winners(e).first().seq == 0


def _cards(spark, n=60):
    rows = [(1, "recog", i, i % 5, i % 2, 1.0 + i, 5.0, 1, 0, 0, T0 + (i * 7919) % 90_000 - 45_000, (T0 + (i * 7919) % 90_000 - 45_000 - 14_400) // S.DAY, T0 - 100_000, 1, i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "learner_id long, deck string, card_id long, " + R.STATE)


def test_previews_rise(spark):
    for p in (Parameters(), Parameters(fuzz=True), Parameters(learning_steps=(), relearning_steps=())):
        for r in R.preview(_cards(spark).where("state <> 4"), T0, p).collect():
            assert r.again < r.hard < r.good < r.easy


def test_mixed_plan(spark):
    rows = [(1, "d", i, "review" if i < 7 else "new", i if i < 7 else i - 7) for i in range(10)]
    got = N.ordered(spark.createDataFrame(rows, "learner_id long, deck string, card_id long, queue string, place int")).orderBy("pos").collect()
    assert [r.card_id for r in got] == [0, 1, 2, 3, 4, 7, 5, 6, 8, 9]


def test_next_card_and_wait(spark):
    queued = N.queues(_cards(spark), T0)
    best = N.next_cards(queued).first()
    assert best.queue == "learn" and best.due_ts == min(r.due_ts for r in queued.where("queue = 'learn'").collect())
    assert N.wait_seconds(_cards(spark), T0).first().wait == 0
    later = _cards(spark).where("state in (1, 3)").withColumn("due_ts", F.lit(T0 + 77).cast("long"))
    assert N.wait_seconds(later, T0).first().wait == 77


def test_interval_text(spark):
    values = [0, 1, 59, 60, 3600, 7200, 86_400, 7 * 86_400, 30 * 86_400, 400 * 86_400, 800 * 86_400]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(S.interval_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == ["0 segundos", "1 segundo", "59 segundos", "1 minuto", "1 hora", "2 horas", "1 día", "1 semana", "1 mes", "1 año", "2 años"]


def _random_log(spark, n=1500, seed=3):
    from decimal import Decimal

    r = random.Random(seed)
    rows = [(r.randint(0, 1), "d", 0 if r.random() < 0.4 else r.randint(1, 30), Decimal(r.randint(0, 2)), i, T0 + r.randint(0, 9_000_000), r.choice(["review"] * 3 + ["undo"]), r.randint(1, 4)) for i in range(n)]
    return spark.createDataFrame(rows, EVENTS)


@pytest.mark.parametrize("long", [0, 40])
def test_brackets_by_range_and_by_card_agree(spark, long):
    e = _random_log(spark)
    shown = lambda d: sorted((r.seq, r.depth, r.later) for r in d.select("seq", "depth", F.coalesce("later", F.lit(-99)).alias("later")).collect())
    assert shown(R.with_depth(e, long)) == shown(R.with_depth(e))
    assert R.live_reviews(e.where("false"), long).count() == 0


def test_pieces_of_a_card_lie_in_several_ranges(spark):
    """One card in many ranges of a few rows each: sums and minima are carried from piece to piece."""
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        e = _random_log(spark, 600, seed=8).withColumn("card_id", F.when(F.col("card_id") > 3, 0).otherwise(F.col("card_id")).cast("long"))
        want = {r.seq for r in R.live_reviews(e).collect()}
        assert {r.seq for r in R.live_reviews(e, 0).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


@pytest.mark.parametrize("p", [Parameters(), Parameters(fuzz=True, leech_threshold=2), Parameters(learning_steps=(), relearning_steps=()), Parameters(learning_steps=(60, 300, 900), relearning_steps=(60, 600))])
def test_long_histories_fold_like_short_ones(spark, p):
    e = _random_log(spark, 800)
    start = spark.createDataFrame([(0, "d", 0, 2, 1, 30.5, 4.4, 3, 1, 9, 5, 5, T0 - 90_000, 7, 1), (1, "d", 3, 4, 1, 30.5, 4.4, 3, 1, 8, 5, 5, T0 - 90_000, 7, 1), (9, "d", 3, 4, 1, 30.5, 4.4, 3, 1, 8, 5, 5, 0, 7, 1)], "learner_id long, deck string, card_id long, " + R.STATE)
    shown = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    for begun in (None, start):
        assert shown(R.replay(e, p, begun, long=0)) == shown(R.replay(e, p, begun)) == shown(R.replay(e, p, begun, long=40))


def test_undo_is_bounded_and_says_so():
    from lexiflow.operators.fold import Card, Ledger, answered

    p, led, states = Parameters(), Ledger(depth=3), [Card()]
    for k in range(6):
        led.answer(3, T0 + k * 90_000, p)
        states.append(answered(states[-1], 3, T0 + k * 90_000, p))
    assert led.card == states[-1] and len(led.before) == 3 and led.deeper == 3
    for k in (5, 4, 3):
        led.undo()
        assert led.card == states[k] and not led.lost
    led.undo()
    assert led.lost and led.card == states[3]
    none = Ledger()
    none.undo()
    assert none.card == Card() and not none.lost
