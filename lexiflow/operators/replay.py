"""Review replay: the card's state machine folded over its reviews, undo, previews.

The step from one state to the next is one set of column expressions. It serves single answers and previews as plain columns and
whole histories inside ``aggregate`` over a card's sorted reviews, so a log is replayed with one shuffle by card. Cards whose histories are too
long for that are dealt over ranges of the log, and folded with carried state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scheduling as S
from ..functions.scheduling import Parameters
from ..storage import staged
from .fold import fold_sorted

CARD = ["learner_id", "deck", "card_id"]
ORDER = ["ts", "device_id", "seq"]
STATE = "state int, step int, stability double, difficulty double, reps int, lapses int, flags int, due_ts long, due_day long, last_review long, total_answers long, prev_state int"
FIELDS = [part.split()[0] for part in STATE.split(", ")]


#: Rows of one card above which its history is no longer taken as one group: it is dealt over ranges, and folded row by row.
LONG_HISTORY = 50_000


def _move() -> Column:
    return F.when(F.col("type") == "review", 1).when(F.col("type") == "undo", -1).otherwise(0)


def _depth_by_card(events: DataFrame) -> DataFrame:
    """``depth`` and ``later`` by two windows over the same partitioning and opposite orders, one shuffle."""
    card = Window.partitionBy(*CARD)
    ahead = card.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    behind = card.orderBy(*[F.desc(c) for c in ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("depth", F.sum(_move()).over(ahead)).withColumn("later", F.min("depth").over(behind))


def _depth_by_range(events: DataFrame) -> DataFrame:
    """The same for cards of any length, on two levels.

    The log is dealt into even ranges of (card, time); each range has running sums and minima of its own. A card's pieces, one for each range that it spans, then get
    the sum of the pieces before and the least depth of those after. Only the first and the last card of a range go on elsewhere, so there are two such
    pieces for each range at most: a table that small is broadcast.
    """
    put = staged(events.repartitionByRange(*CARD, *ORDER).withColumn("_range", F.spark_partition_id()), "ranges")
    piece = Window.partitionBy("_range", *CARD)
    ahead = piece.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    behind = piece.orderBy(*[F.desc(c) for c in ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    local = staged(put.withColumn("_depth", F.sum(_move()).over(ahead)).withColumn("_later", F.min("_depth").over(behind)), "depths")
    pieces = local.groupBy("_range", *CARD).agg(F.sum(_move()).alias("_sum"), F.min("_depth").alias("_min"))
    of_card = Window.partitionBy(*CARD)
    spans = pieces.withColumn("_pieces", F.count(F.lit(1)).over(of_card)).where("_pieces > 1")
    before = of_card.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    after = of_card.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    spans = spans.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    spans = spans.select("_range", *CARD, "_offset", F.min(F.col("_offset") + F.col("_min")).over(after).alias("_after"))
    joined = local.join(F.broadcast(spans), ["_range", *CARD], "left")
    offset = F.coalesce("_offset", F.lit(0))
    return joined.select(*events.columns, (F.col("_depth") + offset).alias("depth"), F.least(F.col("_later") + offset, "_after").alias("later"))


def long_cards(events: DataFrame, long: int = LONG_HISTORY) -> DataFrame | None:
    """The keys of cards with more than ``long`` rows, counted before the shuffle and written; None if there are none. They are a ``long``-th of the rows at most."""
    found = staged(events.groupBy(*CARD).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long).select(*CARD), "long-cards")
    return None if found.isEmpty() else found


def with_depth(events: DataFrame, long: int = LONG_HISTORY) -> DataFrame:
    """``depth``: reviews less undos of the card so far; ``later``: the least depth after the row, null for the last.

    Cards of more than ``long`` rows go by ranges, so that no task has a card as a whole; the others by card.
    """
    hot = long_cards(events, long)
    if hot is None:
        return _depth_by_card(events)
    return _depth_by_card(events.join(hot, CARD, "left_anti")).unionByName(_depth_by_range(events.join(hot, CARD, "left_semi")))


def live_reviews(events: DataFrame, long: int = LONG_HISTORY) -> DataFrame:
    """Reviews that no undo cancels; an undo cancels the nearest earlier live review of its card.

    A review is cancelled iff the depth later falls below its own: brackets that match.
    """
    return _cancelled(with_depth(events.where(F.col("type").isin("review", "undo")), long))


def with_elapsed(events: DataFrame) -> DataFrame:
    """``elapsed``: seconds since the card's previous row; 0 for the first or when the clock went back."""
    before = F.lag("ts").over(Window.partitionBy(*CARD).orderBy(*ORDER))
    return events.withColumn("elapsed", F.coalesce(F.greatest(F.lit(0), F.col("ts") - before), F.lit(0)))


def _cancelled(found: DataFrame) -> DataFrame:
    return found.where("type = 'review' and (later is null or later >= depth)").drop("depth", "later")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def new_card(ts: Column | None = None, p: Parameters | None = None) -> Column:
    """The state struct of a card that was just added."""
    due = F.lit(0).cast("long") if ts is None else ts.cast("long")
    day = F.lit(0).cast("long") if ts is None else S.logical_day(ts, p)
    values = {"difficulty": F.lit(S.DIFFICULTY[0]), "due_ts": due, "due_day": day}
    return F.struct(*[values.get(n, F.lit(0)).cast(t).alias(n) for n, t in (x.split() for x in STATE.split(", "))])


def _pick(steps: tuple[int, ...], i: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in steps]), i.cast("int")) if steps else F.lit(None).cast("int")


def answer(card: Column, rating: Column, ts: Column, p: Parameters, key: Column | None = None) -> Column:
    """The state struct after one answer.

    ``card`` is a state struct. First stability and difficulty are computed and bound once; then one rule, by state and rating, says whether
    the card leaves for review, or at which step and after how many seconds it comes again. A suspended card only counts the answer.
    """
    state, step, s, d = card["state"], card["step"], card["stability"], card["difficulty"]
    fresh, review, short = state == S.NEW, state == S.REVIEW, state.isin(S.LEARNING, S.RELEARNING)
    again, lapse = rating == S.AGAIN, (state == S.REVIEW) & (rating == S.AGAIN)
    elapsed = F.when((card["last_review"] > 0) & (ts > card["last_review"]), ts - card["last_review"]).otherwise(0)

    def memory(recall: Column) -> Column:
        stability = (
            F.when(fresh, S.initial_stability(rating, p)).when(short, S.short_stability(s, rating, p))
            .when(lapse, S.forget_stability(s, d, recall, p)).when(review, S.recall_stability(s, d, recall, rating, p)).otherwise(s)
        )
        difficulty = F.when(fresh, S.initial_difficulty(rating, p)).when(short | review, S.next_difficulty(d, rating, p)).otherwise(d)
        return F.struct(stability.alias("s"), difficulty.alias("d"))

    n_learn, n_relearn = len(p.learning_steps), len(p.relearning_steps)
    relearning = (state == S.RELEARNING) | lapse
    # the step that a short-term answer leads to, and whether the steps are done
    to = (
        F.when(again, 0).when(fresh, F.when(rating == S.GOOD, 1).otherwise(0))
        .when(state == S.LEARNING, step + F.when(rating >= S.GOOD, 1).otherwise(0)).otherwise(step + 1)
    )
    count = F.when(relearning, n_relearn).otherwise(n_learn)
    leaves = F.when(lapse, n_relearn == 0).when(review, True).when(again, False).otherwise((rating == S.EASY) | (to >= count))
    wait = F.when(relearning, F.coalesce(_pick(p.relearning_steps, to), F.lit(600))).otherwise(F.coalesce(_pick(p.learning_steps, to), F.lit(60)))

    def finish(m: Column) -> Column:
        days = S.interval_days(m["s"], p, key)
        day = F.when(leaves, S.logical_day(ts, p) + days).otherwise(S.logical_day(ts + wait, p))
        lapses = F.when(fresh, 0).otherwise(card["lapses"] + F.when(lapse, 1).otherwise(0))
        flags = card["flags"].bitwiseAND(~S.FLAG_SNOOZED)
        if p.leech_threshold > 0:
            flags = F.when(lapse & (lapses >= p.leech_threshold), flags.bitwiseOR(S.FLAG_LEECH)).otherwise(flags)
        return F.struct(
            F.when(leaves, S.REVIEW).when(relearning, S.RELEARNING).otherwise(S.LEARNING).cast("int").alias("state"),
            F.when(leaves, F.when(fresh, 0).otherwise(step)).otherwise(to).cast("int").alias("step"),
            m["s"].alias("stability"), m["d"].alias("difficulty"),
            (F.when(fresh, 0).otherwise(card["reps"]) + F.when(leaves & ~lapse, 1).otherwise(0)).cast("int").alias("reps"),
            lapses.cast("int").alias("lapses"), flags.cast("int").alias("flags"),
            F.when(leaves, S.day_start(day, p)).otherwise(ts + wait).cast("long").alias("due_ts"), day.cast("long").alias("due_day"),
            ts.cast("long").alias("last_review"), (card["total_answers"] + 1).cast("long").alias("total_answers"), card["prev_state"].cast("int").alias("prev_state"),
        )

    after = _let(_let(S.retrievability(s, elapsed), memory), finish)
    held = F.struct(*[{"last_review": ts.cast("long"), "total_answers": (card["total_answers"] + 1).cast("long"), "flags": card["flags"].bitwiseAND(~S.FLAG_SNOOZED)}.get(n, card[n]).alias(n) for n in FIELDS])
    return F.when(state == S.SUSPENDED, held).otherwise(after)


def replay(events: DataFrame, p: Parameters = Parameters(), start: DataFrame | None = None, long: int = LONG_HISTORY) -> DataFrame:
    """(learner_id, deck, card_id, state fields): each card after all its live reviews.

    ``start`` holds card states to begin from. The reviews of a card with up to ``long`` rows in the log are one row, folded by expressions. A longer one is
    sorted with its neighbours and folded in order with its state carried along, so that a task holds one state and not a history.
    """
    moves = events.where(F.col("type").isin("review", "undo"))
    hot = long_cards(moves, long)
    if hot is None:
        return _replay_rows(_cancelled(_depth_by_card(moves)), p, start)
    some, rest = (None, None) if start is None else (start.join(hot, CARD, "left_semi"), start.join(hot, CARD, "left_anti"))
    short = _replay_rows(_cancelled(_depth_by_card(moves.join(hot, CARD, "left_anti"))), p, rest)
    return short.unionByName(_replay_sorted(_cancelled(_depth_by_range(moves.join(hot, CARD, "left_semi"))), p, some))


def _replay_rows(live: DataFrame, p: Parameters, start: DataFrame | None) -> DataFrame:
    history = live.groupBy(*CARD).agg(F.array_sort(F.collect_list(F.struct(*ORDER, "rating"))).alias("history"))
    key = F.xxhash64(*CARD)
    if start is None:
        begun = history.withColumn("begin", new_card())
    else:
        begun = history.join(start.select(*CARD, F.struct(*FIELDS).alias("begin")), CARD, "left").withColumn("begin", F.coalesce("begin", new_card()))
    return fold(begun.withColumn("card_key", key), p)


def _replay_sorted(live: DataFrame, p: Parameters, start: DataFrame | None) -> DataFrame:
    """Cards dealt by key, sorted in their tasks, which spills where it must, and folded row by row; a state to begin from is the first row of its card."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in STATE.split(", "))]
    rows = live.select(*CARD, F.lit(1).alias("_k"), *ORDER, "rating", *none)
    if start is not None:
        known = start.join(live.select(*CARD).distinct(), CARD, "left_semi")
        rows = rows.unionByName(known.select(*CARD, F.lit(0).alias("_k"), *FIELDS), allowMissingColumns=True)
    ordered = rows.repartition(*CARD).sortWithinPartitions(*CARD, "_k", *ORDER).select(*CARD, F.xxhash64(*CARD).alias("card_key"), F.col("rating").cast("int"), "ts", *FIELDS)
    schema = T.StructType([live.schema[c] for c in CARD] + list(T.StructType.fromDDL(STATE).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kinds = [], to_arrow_schema(schema)
        for row in fold_sorted(batches, len(CARD), p):
            found.append(row)
            if len(found) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)

    return ordered.mapInArrow(run, schema)


def fold(begun: DataFrame, p: Parameters) -> DataFrame:
    """(card key, state fields): ``begin`` after each entry (ts, rating) of ``history``; ``card_key`` seeds the fuzz."""
    seed = lambda acc: F.concat_ws(":", F.col("card_key").cast("string"), acc["total_answers"].cast("string"))
    folded = begun.withColumn("card", F.aggregate("history", F.col("begin"), lambda acc, e: answer(acc, e["rating"], e["ts"], p, seed(acc))))
    return folded.select(*CARD, "card.*")


def apply_answers(cards: DataFrame, answers: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """One answer (card key, rating, ts) for each of some cards, as plain columns; cards without an answer stay."""
    both = cards.join(answers, CARD, "left")
    now = F.struct(*FIELDS)
    after = F.when(F.col("rating").isNull(), now).otherwise(answer(now, F.col("rating"), F.col("ts"), p))
    return both.select(*CARD, after.alias("card")).select(*CARD, "card.*")


def preview(cards: DataFrame, now: int, p: Parameters = Parameters()) -> DataFrame:
    """(card key, again, hard, good, easy): seconds until the card would come again; each above the one before.

    A day-long interval counts whole days. Where one is not longer than the one before, it gets a day more if both are days, else a minute
    more, made up to whole days if it is one.
    """
    at = F.lit(now).cast("long")
    card = F.struct(*FIELDS)
    seconds, days = [], []
    for r in (S.AGAIN, S.HARD, S.GOOD, S.EASY):
        due = answer(card, F.lit(r), at, p)["due_ts"]
        delta = F.when(F.col("state") == S.SUSPENDED, F.lit(0)).otherwise(F.greatest(F.lit(0), due - at)).cast("long")
        seconds.append(delta.alias(f"raw{r}"))
    out = cards.select(*CARD, *seconds)
    for r in (1, 2, 3, 4):
        long_ = F.col(f"raw{r}") >= S.DAY
        value = F.when(long_, F.floor(F.col(f"raw{r}") / S.DAY) * S.DAY).otherwise(F.col(f"raw{r}")).cast("long")
        if p.fuzz and r > 1:
            value = F.when(long_, S.fuzz_preview(F.floor(value / S.DAY).cast("long"), F.concat_ws(":", *[F.col(c).cast("string") for c in CARD]), p) * S.DAY).otherwise(value)
        out = out.withColumn(f"d{r}", long_).withColumn(f"s{r}", value)
    for r in (2, 3, 4):
        before = F.col(f"s{r - 1}")
        minute = F.when(F.col(f"d{r}"), F.ceil((before + 60) / S.DAY) * S.DAY).otherwise(before + 60)
        more = F.when(F.col(f"d{r}") & F.col(f"d{r - 1}"), before + S.DAY).otherwise(minute).cast("long")
        out = out.withColumn(f"s{r}", F.when(F.col(f"s{r}") <= before, more).otherwise(F.col(f"s{r}")))
    return out.select(*CARD, F.col("s1").alias("again"), F.col("s2").alias("hard"), F.col("s3").alias("good"), F.col("s4").alias("easy"))
