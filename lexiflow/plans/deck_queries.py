"""Queries over card tables and event logs: plans, commands, merge, rebuild, snapshots, library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scheduling as S
from ..functions import text as X
from ..functions.scheduling import Parameters
from ..operators import cards as C
from ..operators import lexicon as L
from ..operators import library as B
from ..operators import plan as N
from ..operators import replay as R
from ..operators import sync as Y
from . import views as W
from .registry import query

P = Parameters()
NOW = W.NOW
TODAY = (NOW - P.day_offset) // S.DAY
EV = W.sql(W.REVIEW_EVENTS)
CA = W.sql(W.REVIEW_EVENTS, W.CARDS)
IM = W.sql(W.REVIEW_EVENTS, W.IMAGE_EVENTS)
KEY = "learner_id, deck, card_id"
LIST = list(R.FIELDS)
FIELDS = ", ".join(LIST)
same = lambda a, b: f"{a}.learner_id = {b}.learner_id AND {a}.deck = {b}.deck AND {a}.card_id = {b}.card_id"


def _shown(df, *more):
    return df.withColumn("stability", F.round("stability", 6)).select(*R.CARD, "state", "stability", "flags", "due_ts", "due_day", *more)


SHOWN = f"{KEY}, state, round(stability, 6) AS stability, flags, due_ts, due_day"

# ------------------------------------------------------------------ plans

# new cards come in the order of a hash that SQL does not have; the queries below that show places leave them out or count them
QUEUE = CA + f""", q AS (SELECT *, CASE WHEN state = 0 THEN 'new' WHEN state IN (1, 3) THEN CASE WHEN due_ts <= {NOW} THEN 'learn' ELSE 'pending' END WHEN state = 2 THEN CASE WHEN due_day <= {TODAY} THEN 'review' ELSE 'later' END END AS queue FROM cards),
queued AS (SELECT *, row_number() OVER (PARTITION BY learner_id, deck, queue ORDER BY due_ts, card_id) - 1 AS place FROM q WHERE queue IS NOT NULL)"""


def _queues(spark, sf, p=P):
    return N.queues(W.cards(spark, sf), NOW, p)


@query("w5_queue_rank", QUEUE + f" SELECT {KEY}, queue, place::INTEGER AS place FROM queued WHERE queue <> 'new'")
def w5(spark, sf):
    return _queues(spark, sf).where("queue <> 'new'").select(*R.CARD, "queue", "place")


def _counters(spark, sf):
    from ..operators.stats import day_counters

    done = W.review_events(spark, sf).where("type = 'review'").withColumn("prev_state", F.when(F.col("seq") % 3 == 0, S.NEW).otherwise(S.REVIEW))
    return day_counters(done).where(F.col("day") == TODAY)


COUNTERS = f"""counters AS (SELECT learner_id, deck, count(*) FILTER (seq % 3 = 0) AS n, count(*) FILTER (seq % 3 <> 0) AS r FROM review_events WHERE type = 'review' AND floor((ts - 14400) / 86400) = {TODAY} GROUP BY ALL)"""


@query("w6_daily_limits", QUEUE + ", " + COUNTERS + " SELECT q.learner_id, q.deck, q.queue, count(*) AS n FROM queued q LEFT JOIN counters c ON c.learner_id = q.learner_id AND c.deck = q.deck WHERE CASE queue WHEN 'new' THEN place < 3 - coalesce(n, 0) WHEN 'review' THEN place < 10 - coalesce(r, 0) ELSE true END GROUP BY ALL")
def w6(spark, sf):
    p = Parameters(new_per_day=3, reviews_per_day=10)
    return N.within_limits(_queues(spark, sf, p), _counters(spark, sf), p).groupBy("learner_id", "deck", "queue").agg(F.count(F.lit(1)).alias("n"))


def _order_sql(keys: str) -> str:
    return QUEUE + f" SELECT learner_id, deck, pos::INTEGER AS pos, queue, CASE WHEN queue = 'review' THEN card_id END AS review_id FROM (SELECT *, row_number() OVER (PARTITION BY learner_id, deck ORDER BY {keys}) - 1 AS pos FROM queued WHERE queue IN ('review', 'new'))"


def _order(spark, sf, mode):
    done = N.ordered(_queues(spark, sf), Parameters(order_mode=mode))
    return done.select("learner_id", "deck", "pos", "queue", F.when(F.col("queue") == "review", F.col("card_id")).alias("review_id"))


@query("w7_mixed_interleave", _order_sql("CASE WHEN queue = 'new' THEN place ELSE place // 5 END, queue = 'new', place"))
def w7(spark, sf):
    return _order(spark, sf, "mixed")


@query("w8_review_first", _order_sql("queue = 'new', place"))
def w8a(spark, sf):
    return _order(spark, sf, "review_first")


@query("w8_new_first", _order_sql("queue <> 'new', place"))
def w8b(spark, sf):
    return _order(spark, sf, "new_first")


@query("w10_new_shuffle", CA + f" SELECT {KEY}, (row_number() OVER (PARTITION BY learner_id, deck ORDER BY ('0x' || substr(md5('0:' || card_id), 1, 13))::BIGINT, card_id) - 1)::INTEGER AS place FROM cards WHERE state = 0")
def w10(spark, sf):
    return _queues(spark, sf).where("queue = 'new'").select(*R.CARD, "place")


NEXT = QUEUE + ", nxt AS (SELECT * FROM queued QUALIFY row_number() OVER (PARTITION BY learner_id, deck ORDER BY CASE queue WHEN 'learn' THEN 0 WHEN 'review' THEN 1 WHEN 'new' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END, place) = 1)"


def _hide_new(df):
    return df.withColumn("card_id", F.when(F.col("queue") == "new", -1).otherwise(F.col("card_id")))


@query("k7_next_card", NEXT + " SELECT learner_id, deck, queue, CASE WHEN queue = 'new' THEN -1 ELSE card_id END AS card_id FROM nxt")
def k7(spark, sf):
    return _hide_new(N.next_cards(_queues(spark, sf))).select("learner_id", "deck", "queue", "card_id")


@query("k8_session_limit", NEXT + ", s AS (SELECT learner_id, deck, count(*) AS done FROM review_events GROUP BY ALL) SELECT n.learner_id, n.deck, n.queue FROM nxt n JOIN s ON s.learner_id = n.learner_id AND s.deck = n.deck WHERE done < 510")
def k8(spark, sf):
    sessions = W.review_events(spark, sf).groupBy("learner_id", "deck").agg(F.count(F.lit(1)).alias("cards_done")).withColumn("session_limit", F.lit(510))
    return N.next_cards(_queues(spark, sf), P, sessions).select("learner_id", "deck", "queue")


@query("k9_cross_deck", NEXT + f" SELECT learner_id, deck, queue, due_ts FROM nxt QUALIFY row_number() OVER (PARTITION BY learner_id ORDER BY state IN (1, 3) AND due_ts <= {NOW} DESC, due_ts, deck = 'recog' DESC) = 1")
def k9(spark, sf):
    # new cards are told apart by due time only, so their shuffle must not matter here
    queued = N.queues(W.cards(spark, sf), NOW)
    from pyspark.sql import Window

    by_due = queued.withColumn("place", F.row_number().over(Window.partitionBy("learner_id", "deck", "queue").orderBy("due_ts", "card_id")) - 1)
    return N.choose_deck(N.next_cards(by_due), NOW).select("learner_id", "deck", "queue", "due_ts")


DECKED = CA + ", " + W.CUSTOM_DECKS + ", mine AS (SELECT DISTINCT ent_seq FROM custom_decks WHERE deck_id = 'signup')"


def _mine(spark, sf):
    return W.custom_decks(spark, sf).where("deck_id = 'signup'")


@query("k10_filtered_next", DECKED + f" SELECT learner_id, deck, card_id FROM cards WHERE card_id IN (SELECT ent_seq FROM mine) AND state <> 4 AND (state <> 2 OR due_day <= {TODAY}) QUALIFY row_number() OVER (PARTITION BY learner_id, deck ORDER BY state IN (1, 3) DESC, due_ts, card_id) = 1")
def k10(spark, sf):
    return N.next_filtered(W.cards(spark, sf), _mine(spark, sf), NOW)


@query("k11_serve_guard", CA + f" SELECT {KEY} FROM cards WHERE state <> 4 AND (state <> 2 OR due_day <= {TODAY})")
def k11(spark, sf):
    return N.servable(W.cards(spark, sf), NOW).select(*R.CARD)


_READY = f"(state = 0 OR (state IN (1, 3) AND due_ts <= {NOW - 10**6}) OR (state = 2 AND due_day <= {(NOW - 10**6 - 14400) // 86400}))"


@query("k12_wait_time", CA + f" SELECT learner_id, CASE WHEN bool_or({_READY}) THEN 0 ELSE coalesce(min(due_ts) FILTER (state <> 4 AND due_ts > {NOW - 10**6}) - {NOW - 10**6}, 0) END AS wait FROM cards WHERE state <> 0 GROUP BY learner_id")
def k12(spark, sf):
    return N.wait_seconds(W.cards(spark, sf).where("state <> 0"), NOW - 10**6)


@query("j7_custom_deck", DECKED + f" SELECT {KEY} FROM cards WHERE card_id IN (SELECT ent_seq FROM mine)")
def j7(spark, sf):
    return C.restrict(W.cards(spark, sf), _mine(spark, sf)).select(*R.CARD)


# ------------------------------------------------------------------ commands

_NEW = f"0 AS state, 0.0::DOUBLE AS stability, 0 AS flags, {NOW}::BIGINT AS due_ts, {TODAY}::BIGINT AS due_day"


def _lapsed(spark, sf):
    return W.cards(spark, sf).where("lapses >= 10").select(*R.CARD, F.lit(NOW).cast("long").alias("ts"))


@query("r5_add_card", CA + f" SELECT {SHOWN} FROM cards UNION ALL SELECT learner_id, 'recall', card_id, {_NEW} FROM (SELECT DISTINCT learner_id + 100 AS learner_id, card_id FROM cards)")
def r5(spark, sf):
    cards = W.cards(spark, sf)
    wanted = cards.select((F.col("learner_id") + 100).alias("learner_id"), F.lit("recall").alias("deck"), "card_id").unionByName(cards.select(*R.CARD)).withColumn("ts", F.lit(NOW).cast("long"))
    return _shown(C.add(cards, wanted))


@query("r6_reset", CA + f" SELECT {SHOWN} FROM cards WHERE lapses < 10 UNION ALL SELECT {KEY}, {_NEW} FROM cards WHERE lapses >= 10")
def r6(spark, sf):
    return _shown(C.reset(W.cards(spark, sf), _lapsed(spark, sf)))


@query("r6_reset_events", CA + f" SELECT {KEY}, {NOW} AS ts, type FROM cards CROSS JOIN (VALUES ('remove'), ('add')) v(type) WHERE lapses >= 10")
def r6_events(spark, sf):
    """The two events of each reset; commands for cards that are not there give none."""
    cards = W.cards(spark, sf)
    absent = cards.select("learner_id", "deck", (-F.col("card_id") - 1).alias("card_id"), F.lit(NOW).cast("long").alias("ts"))
    return C.reset_events(cards, _lapsed(spark, sf).unionByName(absent, allowMissingColumns=True)).select(*R.CARD, "ts", "type")


@query("r7_suspend", CA + f" SELECT {KEY}, CASE WHEN lapses >= 10 THEN 4 ELSE state END AS state, round(stability, 6) AS stability, flags, due_ts, due_day, CASE WHEN lapses >= 10 AND state <> 4 THEN state ELSE prev_state END AS prev_state FROM cards")
def r7a(spark, sf):
    return _shown(C.suspend(W.cards(spark, sf), _lapsed(spark, sf)), "prev_state")


@query("r7_unsuspend", CA + f" SELECT {KEY}, CASE WHEN state <> 4 THEN state WHEN prev_state IN (0, 1, 3) THEN prev_state ELSE 2 END AS state, round(stability, 6) AS stability, flags, CASE WHEN state <> 4 OR prev_state IN (1, 3) THEN due_ts WHEN prev_state = 0 THEN {NOW} ELSE {TODAY * 86400 + 14400} END AS due_ts, CASE WHEN state <> 4 OR prev_state IN (1, 3) THEN due_day ELSE {TODAY} END AS due_day, CASE WHEN state = 4 THEN 0 ELSE prev_state END AS prev_state FROM cards")
def r7b(spark, sf):
    cards = W.cards(spark, sf)
    return _shown(C.unsuspend(cards, cards.select(*R.CARD, F.lit(NOW).cast("long").alias("ts"))), "prev_state")


@query("r8_mark", CA + f" SELECT {KEY}, state, round(stability, 6) AS stability, CASE WHEN card_id % 2 = 0 THEN flags | 2 ELSE flags & ~2 END AS flags, due_ts, due_day FROM cards")
def r8(spark, sf):
    cards = W.cards(spark, sf)
    return _shown(C.mark(cards, cards.select(*R.CARD, (F.col("card_id") % 2 == 0).alias("marked"))))


@query("r9_snooze", CA + f" SELECT {KEY}, state, round(stability, 6) AS stability, CASE WHEN state = 2 THEN flags | 8 ELSE flags END AS flags, CASE WHEN state = 2 THEN {(TODAY + 3) * 86400 + 14400} ELSE due_ts END AS due_ts, CASE WHEN state = 2 THEN {TODAY + 3} ELSE due_day END AS due_day FROM cards")
def r9(spark, sf):
    cards = W.cards(spark, sf)
    return _shown(C.snooze(cards, cards.select(*R.CARD, F.lit(NOW).cast("long").alias("ts"), F.lit(3).alias("days"))))


@query("r10_due_flag", CA + f" SELECT {KEY}, state, round(stability, 6) AS stability, CASE WHEN due_day <= {TODAY} THEN flags | 4 ELSE flags & ~4 END AS flags, due_ts, due_day FROM cards")
def r10(spark, sf):
    return _shown(C.refresh_due(W.cards(spark, sf), NOW))


@query("u4_card_removal", CA + f" SELECT {SHOWN} FROM cards WHERE lapses < 10")
def u4(spark, sf):
    return _shown(C.remove(W.cards(spark, sf), _lapsed(spark, sf)))


@query("j10_membership", CA + f", ids AS (SELECT DISTINCT learner_id, d AS deck, card_id FROM review_events, (VALUES ('recog'), ('recall'), ('third')) v(d)) SELECT i.learner_id, i.deck, i.card_id, c.card_id IS NOT NULL AS present FROM ids i LEFT JOIN cards c ON {same('i', 'c')}")
def j10(spark, sf):
    ids = W.review_events(spark, sf).select("learner_id", "card_id").distinct().select("learner_id", F.explode(F.array(F.lit("recog"), F.lit("recall"), F.lit("third"))).alias("deck"), "card_id")
    return C.members(ids, W.cards(spark, sf)).select(*R.CARD, "present")


@query("j11_missing_recall", CA + ", c AS (SELECT * FROM cards WHERE deck = 'recog' OR lapses < 10) SELECT learner_id, card_id FROM c WHERE deck = 'recog' EXCEPT SELECT learner_id, card_id FROM c WHERE deck = 'recall'")
def j11(spark, sf):
    return C.missing_recall(W.cards(spark, sf).where("deck = 'recog' or lapses < 10"))


@query("p12_library_filter", CA + ", w AS (SELECT learner_id, card_id, max(state) FILTER (deck = 'recog') AS a, max(state) FILTER (deck = 'recall') AS b FROM cards GROUP BY ALL) SELECT f AS filter, count(*) AS n FROM w, (VALUES ('All'), ('New'), ('Learning'), ('Review'), ('Suspended')) v(f) WHERE CASE f WHEN 'All' THEN true WHEN 'New' THEN coalesce(a = 0, false) OR coalesce(b = 0, false) WHEN 'Learning' THEN coalesce(a IN (1, 3), false) OR coalesce(b IN (1, 3), false) WHEN 'Review' THEN coalesce(a = 2, false) OR coalesce(b = 2, false) ELSE coalesce(a = 4, false) OR coalesce(b = 4, false) END GROUP BY f")
def p12(spark, sf):
    rows = B.two_decks(W.cards(spark, sf))
    return rows.select(F.explode(F.array(*[F.when(C.passes(n, F.col("recog.state"), F.col("recall.state")), n) for n in C.FILTERS])).alias("filter")).where("filter is not null").groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


@query("p13_language_activation", "SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang || ',en' ELSE 'en' END AS codes FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, 'en' FROM documents WHERE lang = 'en'")
def p13(spark, sf):
    from ..functions.vocabulary import LANGUAGES

    text = F.concat(F.col("lang"), F.lit(" , nope, en"))
    return W.table(spark, sf, "documents").select("doc_id", F.array_join(C.active_codes(text, F.lit(list(LANGUAGES))), ",").alias("codes"))


@query("p14_parameters", """SELECT p_partkey AS learner_id, CASE WHEN p_size / 50.0::DOUBLE BETWEEN 0.7 AND 0.97 THEN p_size / 50.0::DOUBLE ELSE 0.9::DOUBLE END AS retention, CASE WHEN p_size - 10 > 0 THEN p_size - 10 ELSE 36500 END AS maximum_interval,
  CASE WHEN p_size - 20 >= 0 THEN p_size - 20 ELSE 20 END AS new_per_day, CASE WHEN 30 - p_size >= 0 THEN 30 - p_size ELSE 200 END AS reviews_per_day, CASE WHEN p_size - 5 >= 1 THEN p_size - 5 ELSE 8 END AS leech_threshold, CASE WHEN p_size * 3000 BETWEEN 0 AND 86399 THEN p_size * 3000 ELSE 14400 END AS day_offset,
  CASE WHEN p_size % 2 = 0 THEN p_size || 'm' ELSE '1m 10m' END AS learning_steps, CASE WHEN p_size % 3 = 0 THEN p_size || 's' ELSE '10m' END AS relearning_steps, CASE WHEN p_size * 4000 BETWEEN 1 AND 90000 THEN p_size * 4000 ELSE 20000 END AS max_results,
  CASE WHEN p_size * 3 > 100 THEN 100 WHEN p_size * 3 >= 1 THEN p_size * 3 ELSE 20 END AS page_size, CASE WHEN p_size % 5 BETWEEN 0 AND 2 THEN p_size % 5 ELSE 0 END AS order_mode FROM part""")
def p14(spark, sf):
    n, c = F.col("p_size"), F.col("p_size").cast("string")
    raw = W.table(spark, sf, "part").select(
        F.col("p_partkey").alias("learner_id"), (n / 50.0).alias("retention"), (n - 10).alias("maximum_interval"), (n - 20).alias("new_per_day"), (30 - n).alias("reviews_per_day"), (n - 5).alias("leech_threshold"), (n * 3000).alias("day_offset"),
        F.when(n % 2 == 0, F.concat(c, F.lit("m"))).otherwise("none").alias("learning_steps"), F.when(n % 3 == 0, F.concat(c, F.lit("s"))).otherwise("0m").alias("relearning_steps"), (n * 4000).alias("max_results"), (n * 3).alias("page_size"), (n % 5).alias("order_mode"),
    )
    return C.valid_parameters(raw)


# ------------------------------------------------------------------ logs of many devices


def _two_logs(spark, sf):
    e = W.image_events(spark, sf)
    return e.where("device_id <= 1"), e.where("device_id >= 1")


@query("u3_log_union", IM + " SELECT device_id, seq, learner_id, type FROM image_events")
def u3(spark, sf):
    return Y.union_logs(*_two_logs(spark, sf)).select("device_id", "seq", "learner_id", "type")


@query("j9_unseen_events", IM + " SELECT device_id, seq, type FROM image_events WHERE device_id = 2")
def j9(spark, sf):
    return Y.unseen(*_two_logs(spark, sf)).select("device_id", "seq", "type")


LIVE = f"""depth AS (SELECT *, sum(CASE WHEN type = 'review' THEN 1 ELSE -1 END) OVER (PARTITION BY {KEY} ORDER BY ts, device_id, seq) AS depth FROM image_events WHERE type IN ('review', 'undo')),
later AS (SELECT *, min(depth) OVER (PARTITION BY {KEY} ORDER BY ts, device_id, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM depth),
eff AS (SELECT * EXCLUDE (depth, later) FROM later WHERE type = 'review' AND (later IS NULL OR later >= depth) UNION ALL SELECT * FROM image_events WHERE type NOT IN ('review', 'undo'))"""
WIN = f"win AS (SELECT * FROM eff QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY ts DESC, device_id DESC, seq DESC) = 1)"


@query("w1_last_writer_wins", IM + f", w AS (SELECT * FROM image_events WHERE type <> 'undo' QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY ts DESC, device_id DESC, seq DESC) = 1) SELECT {KEY}, device_id, seq, type FROM w")
def w1(spark, sf):
    return Y.winners(W.image_events(spark, sf).where("type <> 'undo'")).select(*R.CARD, "device_id", "seq", "type")


REBUILT = f"SELECT {KEY}, state, round(stability, 6) AS stability, reps, due_ts, floor((due_ts - 14400) / 86400)::BIGINT AS due_day, ts AS winning_timestamp FROM win WHERE type <> 'remove'"


def _rebuilt(df):
    return df.select(*R.CARD, "state", F.round("stability", 6).alias("stability"), "reps", "due_ts", "due_day", "winning_timestamp")


@query("r12_state_rebuild", IM + ", " + LIVE + ", " + WIN + " " + REBUILT)
def r12(spark, sf):
    return _rebuilt(Y.rebuild(W.image_events(spark, sf)))


@query("r14_compaction", IM + ", " + LIVE + ", " + WIN + " " + REBUILT)
def r14(spark, sf):
    """A snapshot of the whole log, written, versioned and read back."""
    from ..sources import tables as T
    from ..storage import fresh_path

    snapshot, _ = Y.compact(W.image_events(spark, sf))
    at = T.save_snapshot(snapshot, fresh_path(spark, "snapshots"), 1)
    return _rebuilt(T.read_versioned(spark, at))


@query("r14_log_retirement", IM + ", " + LIVE + ", " + WIN + " " + REBUILT)
def r14_retired(spark, sf):
    """Half the log is compacted and retired, twice; with the rest it rebuilds what the whole log does."""
    from ..sources import log as G
    from ..storage import fresh_path

    at = fresh_path(spark, "log")
    events = W.image_events(spark, sf)
    most = events.agg(F.max("seq") + 1).first()[0]
    for k in range(4):
        G.append_log(events.where(F.floor(F.col("seq") * 4 / most) == k), at, size=max(1, most // 6))
        if k in (1, 2):
            G.compact_log(spark, at)
            G.retire_log(spark, at)
    return _rebuilt(Y.rebuild(G.read_log(spark, at)))


@query("j12_snapshot_upsert", W.sql(W.REVIEW_EVENTS, W.CARDS) + f" SELECT {KEY}, CASE WHEN lapses >= 10 THEN 2 ELSE state END AS state, CASE WHEN lapses >= 10 THEN 99 ELSE reps END AS reps FROM cards UNION ALL SELECT learner_id + 100, deck, card_id, 2, 99 FROM cards WHERE lapses >= 10")
def j12(spark, sf):
    cards = W.cards(spark, sf)
    some = cards.where("lapses >= 10").withColumn("state", F.lit(2)).withColumn("reps", F.lit(99))
    return Y.upsert(cards, some.unionByName(some.withColumn("learner_id", F.col("learner_id") + 100))).select(*R.CARD, "state", "reps")


@query("r13_load", W.sql(W.REVIEW_EVENTS, W.CARDS, W.IMAGE_EVENTS) + ", " + LIVE + ", " + WIN + f""" SELECT c.learner_id, c.deck, c.card_id, coalesce(w.reps, CASE WHEN c.lapses >= 10 THEN 99 ELSE c.reps END) AS reps FROM cards c LEFT JOIN win w ON {same('c', 'w')} WHERE coalesce(w.type, '') <> 'remove'
  UNION ALL SELECT w.learner_id, w.deck, w.card_id, w.reps FROM win w LEFT JOIN cards c ON {same('c', 'w')} WHERE c.card_id IS NULL AND w.type <> 'remove'""")
def r13(spark, sf):
    cards = W.cards(spark, sf)
    snapshot = cards.where("lapses >= 10").withColumn("reps", F.lit(99))
    events = W.image_events(spark, sf).withColumn("total_answers", F.lit(0).cast("long")).withColumn("prev_state", F.lit(0))
    return Y.load(cards, snapshot, events).select(*R.CARD, "reps")


@query("a6_version_vector", IM + " SELECT device_id, max(seq) AS seq FROM image_events GROUP BY device_id")
def a6(spark, sf):
    return Y.version_vector(W.image_events(spark, sf))


@query("a7_next_sequence", IM + " SELECT device_id, max(seq) + 1 AS next_seq FROM image_events GROUP BY device_id")
def a7(spark, sf):
    return Y.next_sequence(W.image_events(spark, sf))


@query("a8_distinct_cards", IM + ", " + LIVE + f" SELECT DISTINCT {KEY} FROM eff")
def a8(spark, sf):
    return Y.touched(W.image_events(spark, sf))


@query("a9_last_event", IM + ", " + LIVE + f" SELECT {KEY}, max(ts) AS winning_timestamp FROM eff GROUP BY ALL")
def a9(spark, sf):
    return Y.last_event(W.image_events(spark, sf))


@query("k13_delta", IM + ", m AS (SELECT device_id, max(seq) // 2 AS mark FROM image_events WHERE device_id > 0 GROUP BY device_id) SELECT device_id, seq, type FROM image_events LEFT JOIN m USING (device_id) WHERE seq > coalesce(mark, -1)")
def k13(spark, sf):
    e = W.image_events(spark, sf)
    marks = Y.version_vector(e.where("device_id > 0")).withColumn("seq", F.floor(F.col("seq") / 2))
    return Y.delta(e, marks).select("device_id", "seq", "type")


@query("k13_delta_capped", IM + """, m AS (SELECT device_id, max(seq) // 2 AS mark FROM image_events WHERE device_id > 0 GROUP BY device_id), a AS (SELECT * FROM image_events LEFT JOIN m USING (device_id) WHERE seq > coalesce(mark, -1))
  SELECT device_id, seq, type FROM a QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY seq) <= 100""")
def k13_capped(spark, sf):
    """A hundred events of each device at most, the first ones; every task keeps no more than that before the shuffle."""
    e = W.image_events(spark, sf)
    marks = Y.version_vector(e.where("device_id > 0")).withColumn("seq", F.floor(F.col("seq") / 2))
    return Y.delta(e, marks, 100).select("device_id", "seq", "type")


@query("r11_event_recording", CA + f" SELECT {KEY}, row_number() OVER (ORDER BY {KEY}) AS seq, 'suspend' AS type, 4 AS state, flags FROM cards WHERE lapses >= 10 AND state <> 4")
def r11(spark, sf):
    cards = W.cards(spark, sf)
    return Y.record(cards, C.suspend(cards, _lapsed(spark, sf)), "suspend", 7, 1, NOW).select(*R.CARD, "seq", "type", "state", "flags")


# ------------------------------------------------------------------ library

LIB = W.sql(W.REVIEW_EVENTS, W.CARDS, W.ENTRIES) + ", lib AS (SELECT learner_id, card_id AS ent_seq, max(state) FILTER (deck = 'recog') AS recog_state, max(state) FILTER (deck = 'recall') AS recall_state FROM cards GROUP BY ALL)"


def _lib(spark, sf):
    return B.two_decks(W.cards(spark, sf))


@query("j5_two_decks", LIB + " SELECT * FROM lib")
def j5(spark, sf):
    return _lib(spark, sf).select("learner_id", "ent_seq", F.col("recog.state").alias("recog_state"), F.col("recall.state").alias("recall_state"))


@query("j6_cards_of_entries", LIB + " SELECT learner_id, ent_seq, CASE WHEN p_size % 5 = 0 THEN string_split(p_name, ' ')[1] ELSE p_name END AS headword FROM lib JOIN entries USING (ent_seq)")
def j6(spark, sf):
    return B.with_entries(_lib(spark, sf), W.entries(spark, sf)).select("learner_id", "ent_seq", L.headword().alias("headword"))


@query("j8_library_search", LIB + " SELECT learner_id, ent_seq FROM lib JOIN entries USING (ent_seq) WHERE contains(p_name, 'bo') OR p_size <= 3")
def j8(spark, sf):
    rows = B.with_entries(_lib(spark, sf), W.entries(spark, sf))
    hits = W.table(spark, sf, "part").where("p_size <= 3").select(F.col("p_partkey").alias("ent_seq"))
    return B.search_library(rows, F.concat(F.col("k_ele.keb"), F.array(F.array_join(F.slice(F.col("r_ele.reb"), 1, 2), " "))), hits, "bo").select("learner_id", "ent_seq")


@query("k14_library_paging", LIB + " SELECT learner_id, ent_seq, ((row_number() OVER (PARTITION BY learner_id ORDER BY ent_seq) - 1) // 20)::INTEGER AS page FROM lib")
def k14(spark, sf):
    return B.paged(_lib(spark, sf)).select("learner_id", "ent_seq", "page")


@query("p11_card_face", LIB + " SELECT c.learner_id, c.deck, c.card_id, CASE WHEN c.deck = 'recall' THEN e.p_type ELSE e.p_name END AS question, CASE WHEN c.deck = 'recall' THEN e.p_name ELSE e.p_type END AS answer FROM cards c JOIN entries e ON e.ent_seq = c.card_id")
def p11(spark, sf):
    rows = W.cards(spark, sf).withColumnRenamed("card_id", "ent_seq").join(W.table(spark, sf, "part").withColumnRenamed("p_partkey", "ent_seq"), "ent_seq")
    face = L.card_face(F.col("deck"), F.col("p_name"), F.col("p_type"))
    return rows.select("learner_id", "deck", F.col("ent_seq").alias("card_id"), face["question"].alias("question"), face["answer"].alias("answer"))


@query("u0_kana_library", LIB + " SELECT learner_id, ent_seq FROM lib JOIN entries USING (ent_seq) WHERE contains(p_name, 'red')")
def u0(spark, sf):
    rows = _lib(spark, sf).join(W.table(spark, sf, "part").select(F.col("p_partkey").alias("ent_seq"), "p_name"), "ent_seq")
    return B.search_library(rows, F.array(X.fold_kana(F.col("p_name"))), None, "red").select("learner_id", "ent_seq")
