"""Queries over review logs: scheduling arithmetic, replay, undo, previews, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scheduling as S
from ..functions.scheduling import Parameters
from ..functions.sql import register
from ..operators import replay as R
from ..operators import stats as A
from . import views as W
from .registry import SQL, query

P = Parameters()
NOW = W.NOW
EV = W.sql(W.REVIEW_EVENTS)
CA = W.sql(W.REVIEW_EVENTS, W.CARDS)
KEY = "learner_id, deck, card_id"
DAY = "floor(({} - 14400) / 86400)::BIGINT"


@query("f22_logical_day", EV + f" SELECT seq, {DAY.format('ts')} AS day, {DAY.format('ts')} * 86400 + 14400 AS begins FROM review_events")
def f22(spark, sf):
    day = S.logical_day(F.col("ts"), P)
    return W.review_events(spark, sf).select("seq", day.alias("day"), S.day_start(day, P).alias("begins"))


@query("f23_parse_steps", "SELECT p_partkey, array_to_string(list_filter([p_size * 60, (p_size % 7) * 3600, (p_size % 3) * 86400], lambda x: x > 0), ' ') AS steps FROM part")
def f23(spark, sf):
    n = lambda c: c.cast("string")
    text = F.concat(n(F.col("p_size")), F.lit("m "), n(F.col("p_size") % 7), F.lit("h bad "), n(F.col("p_size") % 3), F.lit("d"))
    return W.table(spark, sf, "part").select("p_partkey", F.array_join(S.parse_steps(text).cast("array<string>"), " ").alias("steps"))


def _interval_sql(x: str) -> str:
    out = "CASE "
    for size, one, many in S.UNITS:
        out += f"WHEN {x} >= {size} THEN ({x} // {size}) || CASE WHEN {x} // {size} = 1 THEN ' {one}' ELSE ' {many}' END "
    return out + "ELSE '0 segundos' END"


@query("f24_interval_text", f"SELECT p_partkey, {_interval_sql('(p_partkey * p_partkey * 17)')} AS t FROM part")
def f24(spark, sf):
    return W.table(spark, sf, "part").select("p_partkey", S.interval_text(F.col("p_partkey") * F.col("p_partkey") * 17).alias("t"))


@query("f25_state_due_text", CA + f" SELECT {KEY}, ['New','Learning','Review','Relearning','Suspended'][state + 1] AS state_text, CASE WHEN state = 0 THEN 'New' WHEN state = 4 THEN 'Suspended' WHEN due_ts <= {NOW} THEN 'Now' ELSE {_interval_sql(f'(due_ts - {NOW})')} END AS due FROM cards")
def f25(spark, sf):
    return W.cards(spark, sf).select(*R.CARD, S.state_text(F.col("state")).alias("state_text"), S.due_text(F.col("state"), F.col("due_ts"), F.lit(NOW)).alias("due"))


@query("f26_last_review_text", CA + f" SELECT {KEY}, CASE WHEN last_review > 0 THEN strftime(to_timestamp(last_review) AT TIME ZONE 'UTC', '%b %-d, %Y') ELSE 'Never' END AS t FROM cards")
def f26(spark, sf):
    return W.cards(spark, sf).select(*R.CARD, S.last_review_text(F.col("last_review")).alias("t"))


_w = [f"{x!r}::DOUBLE" for x in S.WEIGHTS]
_cs = "greatest(0.01::DOUBLE, least(36500::DOUBLE, {}))"
_cd = "greatest(1::DOUBLE, least(10::DOUBLE, {}))"
_S0 = f"greatest([{', '.join(_w[:4])}][{{r}}], 0.1::DOUBLE)"
_D0 = _cd.format(f"{_w[4]} - exp({_w[5]} * ({{r}} - 1)) + 1")
_SHORT = _cs.format(f"{{s}} * exp({_w[17]} * (({{r}} - 3) + {_w[18]}))")
_RECALL = _cs.format(f"{{s}} * (exp({_w[8]}) * (11 - {{d}}) * pow({{s}}, -{_w[9]}) * (exp({_w[10]} * (1 - {{q}})) - 1) * CASE {{r}} WHEN 2 THEN {_w[15]} WHEN 4 THEN {_w[16]} ELSE 1 END + 1)")
_FORGET = _cs.format(f"{_w[11]} * pow({{d}}, -{_w[12]}) * (pow({{s}} + 1, {_w[13]}) - 1) * exp({_w[14]} * (1 - {{q}}))")
_NEXT_D = _cd.format(f"{_w[7]} * {_D0.format(r=4)} + (1 - {_w[7]}) * ({{d}} - {_w[6]} * ({{r}} - 3))")
_IVL = "CASE WHEN {s} <= 0 THEN 1 ELSE greatest(1, least(36500, floor(9::DOUBLE * {s} * (1::DOUBLE / 0.9::DOUBLE - 1) + 0.5::DOUBLE))) END::BIGINT"
_Q = "CASE WHEN {s} <= 0 THEN 0 ELSE 1::DOUBLE / (1 + {e} / 86400::DOUBLE / (9 * {s})) END"


@query(
    "f27_f33_memory_model",
    CA + f""", c AS (SELECT *, greatest(stability, 0.01::DOUBLE) AS s, difficulty AS d, (card_id % 4 + 1)::INTEGER AS r, {_Q.format(s='stability', e=f'greatest(0, {NOW} - last_review)')} AS q FROM cards)
    SELECT {KEY}, round(q, 6) AS recall, round({_S0.format(r='r')}, 6) AS s0, round({_D0.format(r='r')}, 6) AS d0, round({_SHORT.format(s='s', r='r')}, 6) AS short, round({_RECALL.format(s='s', d='d', q='q', r='r')}, 6) AS grown,
    round({_FORGET.format(s='s', d='d', q='q')}, 6) AS forgot, round({_NEXT_D.format(d='d', r='r')}, 6) AS d_next, {_IVL.format(s='s')} AS days FROM c""",
)
def f27(spark, sf):
    s, d, r = F.greatest("stability", F.lit(0.01)), F.col("difficulty"), (F.col("card_id") % 4 + 1).cast("int")
    q = S.retrievability(F.col("stability"), F.greatest(F.lit(0), NOW - F.col("last_review")))
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return W.cards(spark, sf).select(
        *R.CARD, r6(q, "recall"), r6(S.initial_stability(r, P), "s0"), r6(S.initial_difficulty(r, P), "d0"), r6(S.short_stability(s, r, P), "short"),
        r6(S.recall_stability(s, d, q, r, P), "grown"), r6(S.forget_stability(s, d, q, P), "forgot"), r6(S.next_difficulty(d, r, P), "d_next"), S.interval_days(s, P).alias("days"),
    )


@query("f22_f33_sql_functions", SQL["f27_f33_memory_model"].replace(" FROM c", f", {DAY.format('last_review')} AS day, {_interval_sql('last_review')} AS age FROM c"))
def f22_sql(spark, sf):
    """The same through SQL alone, by the functions that ``register`` names."""
    register(spark, P)
    now = W.NOW
    return spark.sql(
        f"""WITH c AS (SELECT *, greatest(stability, 0.01D) AS s, difficulty AS d, CAST(card_id % 4 + 1 AS INT) AS r, retrievability(stability, greatest(0, {now} - last_review)) AS q FROM {{cards}})
        SELECT learner_id, deck, card_id, round(q, 6) AS recall, round(initial_stability(r), 6) AS s0, round(initial_difficulty(r), 6) AS d0, round(short_stability(s, r), 6) AS short,
          round(recall_stability(s, d, q, r), 6) AS grown, round(forget_stability(s, d, q), 6) AS forgot, round(next_difficulty(d, r), 6) AS d_next, interval_days(s) AS days,
          logical_day(last_review) AS day, interval_text(last_review) AS age FROM c""",
        cards=W.cards(spark, sf),
    )


_DRAWN = "('0x' || substr(md5('0:' || learner_id || ':' || deck || ':' || card_id), 1, 13))::BIGINT"


@query(
    "f34_interval_fuzz",
    CA + f""", f AS (SELECT {KEY}, total_answers::BIGINT AS days, {_DRAWN} AS h, greatest(1, total_answers * CASE WHEN total_answers < 7 THEN 15 WHEN total_answers < 30 THEN 10 ELSE 5 END // 100)::BIGINT AS off FROM cards)
    SELECT {KEY}, days, CASE WHEN days < 7 THEN days ELSE least(36500, greatest(days - 2, least(days + 2, days * (95 + h % 11) // 100))) END::BIGINT AS fuzzed,
      CASE WHEN days < 2 THEN days ELSE greatest(1, days - off) + h % (days + off - greatest(1, days - off) + 1) END::BIGINT AS previewed FROM f""",
)
def f34(spark, sf):
    p = Parameters(fuzz=True)
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in R.CARD])
    days = F.col("total_answers")
    return W.cards(spark, sf).select(*R.CARD, days.alias("days"), S.fuzz_interval(days, key, p).alias("fuzzed"), S.fuzz_preview(days, key, p).alias("previewed"))


LIVE = f"""depth AS (SELECT *, sum(CASE WHEN type = 'review' THEN 1 ELSE -1 END) OVER (PARTITION BY {KEY} ORDER BY ts, device_id, seq) AS depth FROM review_events),
later AS (SELECT *, min(depth) OVER (PARTITION BY {KEY} ORDER BY ts, device_id, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM depth),
live AS (SELECT * FROM later WHERE type = 'review' AND (later IS NULL OR later >= depth))"""


@query("w2_live_reviews", EV + ", " + LIVE + f" SELECT {KEY}, seq, ts, rating FROM live")
def w2(spark, sf):
    return R.live_reviews(W.review_events(spark, sf)).select(*R.CARD, "seq", "ts", "rating")


#: Rows of a card above which it counts as long in the queries with a hot card.
LONG = 200


@query("w2_hot_card", W.sql(W.HOT_EVENTS) + ", " + LIVE + f" SELECT {KEY}, seq, ts, rating FROM live")
def w2_hot(spark, sf):
    """A third of all events on one card: its brackets are matched over ranges."""
    return R.live_reviews(W.hot_events(spark, sf), LONG).select(*R.CARD, "seq", "ts", "rating")


@query("w3_event_order", EV + f" SELECT {KEY}, seq, row_number() OVER (PARTITION BY {KEY} ORDER BY ts, device_id, seq)::INTEGER AS k FROM review_events")
def w3(spark, sf):
    from pyspark.sql import Window

    return W.review_events(spark, sf).select(*R.CARD, "seq", F.row_number().over(Window.partitionBy(*R.CARD).orderBy(*R.ORDER)).alias("k"))


@query("w4_elapsed", EV + f" SELECT seq, coalesce(greatest(0, ts - lag(ts) OVER (PARTITION BY {KEY} ORDER BY ts, device_id, seq)), 0) AS elapsed FROM review_events")
def w4(spark, sf):
    return R.with_elapsed(W.review_events(spark, sf)).select("seq", "elapsed")


def _step_sql(source: str, leech: int = 8) -> str:
    """SELECT of the state after one answer; ``source`` has the state, rating and ts."""
    q = _Q.format(s="s", e="CASE WHEN last_review > 0 AND ts > last_review THEN ts - last_review ELSE 0 END")
    return f"""SELECT * EXCLUDE (s, d, s2, d2, q, leaves, tostep, wait, rel, lapse, days), 
      CASE WHEN state = 4 THEN s ELSE s2 END AS s, CASE WHEN state = 4 THEN d ELSE d2 END AS d, days, leaves, tostep, wait, rel, lapse FROM (
      SELECT *, {_IVL.format(s='s2')} AS days,
        CASE WHEN lapse THEN FALSE WHEN state = 2 THEN TRUE WHEN rating = 1 THEN FALSE ELSE rating = 4 OR tostep >= CASE WHEN rel THEN 1 ELSE 2 END END AS leaves,
        CASE WHEN rel THEN 600 ELSE coalesce([60, 600][tostep + 1], 60) END AS wait FROM (
      SELECT *, CASE WHEN rating = 1 THEN 0 WHEN state = 0 THEN CASE WHEN rating = 3 THEN 1 ELSE 0 END WHEN state = 1 THEN step + CASE WHEN rating >= 3 THEN 1 ELSE 0 END ELSE step + 1 END AS tostep,
        state = 3 OR lapse AS rel,
        CASE WHEN state = 0 THEN {_S0.format(r='rating')} WHEN state IN (1, 3) THEN {_SHORT.format(s='s', r='rating')} WHEN lapse THEN {_FORGET.format(s='s', d='d', q='q')} WHEN state = 2 THEN {_RECALL.format(s='s', d='d', q='q', r='rating')} ELSE s END AS s2,
        CASE WHEN state = 0 THEN {_D0.format(r='rating')} WHEN state IN (1, 2, 3) THEN {_NEXT_D.format(d='d', r='rating')} ELSE d END AS d2 FROM (
      SELECT *, state = 2 AND rating = 1 AS lapse, {q} AS q FROM {source})))"""


def _after(leech: int = 8) -> str:
    """Columns of the state after the step, from :func:`_step_sql`'s rows."""
    lapses = "(CASE WHEN state = 0 THEN 0 ELSE lapses + CASE WHEN lapse THEN 1 ELSE 0 END END)"
    day = f"CASE WHEN leaves THEN {DAY.format('ts')} + days ELSE {DAY.format('(ts + wait)')} END"
    return f"""CASE WHEN state = 4 THEN 4 WHEN leaves THEN 2 WHEN rel THEN 3 ELSE 1 END AS state,
      (CASE WHEN state = 4 THEN step WHEN leaves THEN CASE WHEN state = 0 THEN 0 ELSE step END ELSE tostep END)::INTEGER AS step, s, d,
      (CASE WHEN state = 4 THEN reps ELSE CASE WHEN state = 0 THEN 0 ELSE reps END + CASE WHEN leaves AND NOT lapse THEN 1 ELSE 0 END END)::INTEGER AS reps,
      (CASE WHEN state = 4 THEN lapses ELSE {lapses} END)::INTEGER AS lapses,
      ((flags & 7) | CASE WHEN lapse AND {lapses} >= {leech} THEN 1 ELSE 0 END)::INTEGER AS flags,
      CASE WHEN state = 4 THEN due_ts WHEN leaves THEN ({day}) * 86400 + 14400 ELSE ts + wait END AS due_ts, CASE WHEN state = 4 THEN due_day ELSE {day} END AS due_day, ts AS last_review, total_answers + 1 AS total_answers"""


def _replay_sql(leech: int = 8, events: str = W.REVIEW_EVENTS) -> str:
    return W.sql(events, LIVE, recursive=True) + f""", o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY ts, device_id, seq) AS rn FROM live),
    rep AS (
      SELECT DISTINCT learner_id, deck, card_id, 0::BIGINT AS rn, 0 AS state, 0 AS step, 0::DOUBLE AS s, 1::DOUBLE AS d, 0 AS reps, 0 AS lapses, 0 AS flags, 0::BIGINT AS due_ts, 0::BIGINT AS due_day, 0::BIGINT AS last_review, 0::BIGINT AS total_answers FROM o
      UNION ALL
      SELECT learner_id, deck, card_id, rn + 1 AS rn, {_after(leech)} FROM ({_step_sql('(SELECT r.*, o.rating, o.ts FROM rep r JOIN o ON o.learner_id = r.learner_id AND o.deck = r.deck AND o.card_id = r.card_id AND o.rn = r.rn + 1)', leech)})),
    final AS (SELECT * FROM rep WHERE rn > 0 QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY rn DESC) = 1)"""


def _rounded(df):
    return df.withColumn("stability", F.round("stability", 6)).withColumn("difficulty", F.round("difficulty", 6))


SHOWN = f"{KEY}, state, step, round(s, 6) AS stability, round(d, 6) AS difficulty, reps, lapses, flags, due_ts, due_day, last_review, total_answers"


@query("r1_answer_replay", _replay_sql() + f" SELECT {SHOWN} FROM final")
def r1(spark, sf):
    return _rounded(R.replay(W.review_events(spark, sf))).drop("prev_state")


@query("r1_hot_card", _replay_sql(events=W.HOT_EVENTS) + f" SELECT {SHOWN} FROM final")
def r1_hot(spark, sf):
    """A third of all events on one card: it is folded in order with its state carried along."""
    return _rounded(R.replay(W.hot_events(spark, sf), long=LONG)).drop("prev_state")


@query("r4_leech_flag", _replay_sql(3) + f" SELECT {KEY}, lapses, flags & 1 = 1 AS leech FROM final")
def r4(spark, sf):
    done = R.replay(W.review_events(spark, sf), Parameters(leech_threshold=3))
    return done.select(*R.CARD, "lapses", (F.col("flags").bitwiseAND(1) == 1).alias("leech"))


_ANSWERED = f"(SELECT * RENAME (stability AS s, difficulty AS d), (card_id % 4 + 1)::INTEGER AS rating, {NOW}::BIGINT AS ts FROM cards)"


@query("r2_single_answer", CA + f" SELECT {SHOWN} FROM (SELECT learner_id, deck, card_id, {_after()} FROM ({_step_sql(_ANSWERED)}))")
def r2(spark, sf):
    cards = W.cards(spark, sf)
    answers = cards.select(*R.CARD, (F.col("card_id") % 4 + 1).cast("int").alias("rating"), F.lit(NOW).cast("long").alias("ts"))
    return _rounded(R.apply_answers(cards, answers)).drop("prev_state")


def _previewed() -> str:
    raw = f"(SELECT * RENAME (stability AS s, difficulty AS d), {NOW}::BIGINT AS ts FROM cards, (VALUES (1), (2), (3), (4)) v(rating))"
    out = CA + f", raw AS (SELECT learner_id, deck, card_id, rating, CASE WHEN was = 4 THEN 0 ELSE greatest(0, due_ts - {NOW}) END AS x FROM (SELECT learner_id, deck, card_id, rating, state AS was, {_after()} FROM ({_step_sql(raw)})))"
    out += ", wide AS (SELECT learner_id, deck, card_id" + "".join(f", max(CASE WHEN rating = {r} THEN x END) AS x{r}" for r in (1, 2, 3, 4)) + " FROM raw GROUP BY ALL)"
    out += ", p1 AS (SELECT *" + "".join(f", x{r} >= 86400 AS d{r}, CASE WHEN x{r} >= 86400 THEN x{r} // 86400 * 86400 ELSE x{r} END AS s{r}" for r in (1, 2, 3, 4)) + " FROM wide)"
    for r in (2, 3, 4):
        b = f"s{r - 1}"
        out += f", p{r} AS (SELECT * REPLACE (CASE WHEN s{r} > {b} THEN s{r} WHEN d{r} AND d{r - 1} THEN {b} + 86400 WHEN d{r} THEN ({b} + 60 + 86399) // 86400 * 86400 ELSE {b} + 60 END AS s{r}) FROM p{r - 1})"
    return out + f" SELECT {KEY}, s1 AS again, s2 AS hard, s3 AS good, s4 AS easy FROM p4"


@query("r3_w9_preview", _previewed())
def r3(spark, sf):
    return R.preview(W.cards(spark, sf), NOW)


@query("w11_undo_restore", EV + ", " + LIVE + f""", c AS (SELECT learner_id, deck, card_id, count(*) FILTER (type = 'review') AS reviews, count(*) FILTER (type = 'undo') AS undos FROM review_events GROUP BY ALL),
  l AS (SELECT learner_id, deck, card_id, count(*) AS kept, arg_max(rating, (ts, device_id, seq)) AS last_rating FROM live GROUP BY ALL)
  SELECT c.learner_id, c.deck, c.card_id, reviews, undos, coalesce(kept, 0) AS kept, last_rating FROM c LEFT JOIN l ON c.learner_id = l.learner_id AND c.deck = l.deck AND c.card_id = l.card_id""")
def w11(spark, sf):
    e = W.review_events(spark, sf)
    counts = e.groupBy(*R.CARD).agg(F.count_if(F.col("type") == "review").alias("reviews"), F.count_if(F.col("type") == "undo").alias("undos"))
    kept = R.live_reviews(e).groupBy(*R.CARD).agg(F.count(F.lit(1)).alias("kept"), F.max_by("rating", F.struct(*R.ORDER)).alias("last_rating"))
    return counts.join(kept, R.CARD, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


_ALIVE = "stability > 0 AND state <> 4"
_TODAY = (NOW - 14400) // 86400
_MEAN = "round(coalesce(avg({}) FILTER (" + _ALIVE + "), 0), 6)"


@query("a3_deck_statistics", CA + f""" SELECT learner_id, deck, count(*) AS total, count(*) FILTER (state = 0) AS new_count, count(*) FILTER (state = 1) AS learning_count, count(*) FILTER (state = 3) AS relearning_count,
  count(*) FILTER (state = 2) AS review_count, count(*) FILTER (state = 4) AS suspended_count, count(*) FILTER (flags & 1 = 1) AS leech_count, count(*) FILTER (lapses > 0) AS cards_with_lapses,
  count(*) FILTER (due_day <= {_TODAY}) AS due_now_all, count(*) FILTER (due_day <= {_TODAY} AND state <> 4) AS due_now_active, count(*) FILTER (due_day = {_TODAY}) AS due_today,
  {_MEAN.format('stability')} AS average_stability, {_MEAN.format('difficulty')} AS average_difficulty, {_MEAN.format(_Q.format(s='stability', e=f'CASE WHEN last_review > 0 AND last_review < {NOW} THEN {NOW} - last_review ELSE 0 END'))} AS retention,
  count(*) FILTER ({_ALIVE} AND stability > 21) AS mature_count, count(*) FILTER ({_ALIVE} AND stability <= 21) AS young_count FROM cards GROUP BY learner_id, deck""")
def a3(spark, sf):
    return A.deck_statistics(W.cards(spark, sf), NOW)


@query("a4_dashboard", CA + f" SELECT learner_id, count(*) AS total, count(*) FILTER (due_day <= {_TODAY} AND state <> 4) AS due, count(*) FILTER (state IN (1, 3)) AS learning, count(*) FILTER (state = 0) AS new, count(*) FILTER (lapses > 0) AS lapsed FROM cards GROUP BY learner_id")
def a4(spark, sf):
    return A.dashboard(W.cards(spark, sf), NOW)


@query("a5_day_counters", EV + ", " + LIVE + f", k AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY ts, device_id, seq) AS k FROM live) SELECT learner_id, deck, {DAY.format('ts')} AS day, count(*) FILTER (k = 1) AS new_done, count(*) FILTER (k = 2) AS learn_done, count(*) FILTER (k > 2) AS review_done, count(*) AS cards_done FROM k GROUP BY ALL")
def a5(spark, sf):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(*R.CARD).orderBy(*R.ORDER))
    before = F.when(k == 1, S.NEW).when(k == 2, S.LEARNING).otherwise(S.REVIEW)
    return A.day_counters(R.live_reviews(W.review_events(spark, sf)).withColumn("prev_state", before))


@query("a10_total_answers", EV + f" SELECT {KEY}, count(*) FILTER (type = 'review') AS total_answers FROM review_events GROUP BY ALL")
def a10(spark, sf):
    return A.total_answers(W.review_events(spark, sf))
