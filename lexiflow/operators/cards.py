"""Commands on card tables: add, remove, reset, suspend, mark, snooze, flags, filters, parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scheduling as S
from ..functions.scheduling import Parameters
from .replay import CARD, FIELDS, new_card


def add(cards: DataFrame, wanted: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """``cards`` and a new card for each wanted (card key, ts) that is not there yet."""
    new = wanted.dropDuplicates(CARD).join(cards, CARD, "left_anti")
    return cards.select(*CARD, *FIELDS).unionByName(new.select(*CARD, new_card(F.col("ts"), p).alias("c")).select(*CARD, "c.*"))


def remove(cards: DataFrame, gone: DataFrame) -> DataFrame:
    return cards.join(gone.select(*CARD).distinct(), CARD, "left_anti")


def reset(cards: DataFrame, wanted: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The wanted cards (card key, ts) are new again; those that are not there stay away."""
    there = wanted.join(cards, CARD, "left_semi")
    return add(remove(cards, there), there, p)


def reset_events(cards: DataFrame, wanted: DataFrame) -> DataFrame:
    """The two events of each reset of a card that is there, the removal first."""
    there = wanted.dropDuplicates(CARD).join(cards, CARD, "left_semi")
    return there.select(*CARD, "ts", F.explode(F.array(F.lit("remove"), F.lit("add"))).alias("type"))


def _set(cards: DataFrame, commands: DataFrame, when: Column, **values: Column) -> DataFrame:
    """``cards`` with new values where a command (card key, ...) meets the condition."""
    marked = commands.dropDuplicates(CARD).withColumn("asked", F.lit(True))
    both = cards.select(*CARD, *FIELDS).join(marked, CARD, "left")
    hit = F.col("asked").isNotNull() & when
    return both.select(*CARD, *[(F.when(hit, values[c]).otherwise(F.col(c)).cast(cards.schema[c].dataType).alias(c) if c in values else F.col(c)) for c in FIELDS])


def suspend(cards: DataFrame, commands: DataFrame) -> DataFrame:
    return _set(cards, commands, F.col("state") != S.SUSPENDED, prev_state=F.col("state"), state=F.lit(S.SUSPENDED))


def unsuspend(cards: DataFrame, commands: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The state from before returns; reviews are due today, new cards now, learning keeps its time. Commands carry ts."""
    before, today = F.col("prev_state"), S.logical_day(F.col("ts"), p)
    short = before.isin(S.LEARNING, S.RELEARNING)
    return _set(
        cards, commands, F.col("state") == S.SUSPENDED,
        state=F.when(before.isin(S.NEW, S.LEARNING, S.RELEARNING), before).otherwise(S.REVIEW),
        due_ts=F.when(short, F.col("due_ts")).when(before == S.NEW, F.col("ts")).otherwise(S.day_start(today, p)),
        due_day=F.when(short, F.col("due_day")).otherwise(today),
        prev_state=F.lit(0),
    )


def mark(cards: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands carry ``marked``."""
    flags = F.col("flags")
    return _set(cards, commands, F.lit(True), flags=F.when(F.col("marked"), flags.bitwiseOR(S.FLAG_MARKED)).otherwise(flags.bitwiseAND(~S.FLAG_MARKED)))


def snooze(cards: DataFrame, commands: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Reviews move ``days`` on from the day of ts; other states do not."""
    day = S.logical_day(F.col("ts"), p) + F.col("days")
    return _set(cards, commands, F.col("state") == S.REVIEW, due_day=day, due_ts=S.day_start(day, p), flags=F.col("flags").bitwiseOR(S.FLAG_SNOOZED))


def refresh_due(cards: DataFrame, now: int, p: Parameters = Parameters()) -> DataFrame:
    """The due flag holds iff the card's day has come."""
    flags = F.col("flags")
    return cards.withColumn("flags", F.when(F.col("due_day") <= S.logical_day(F.lit(now), p), flags.bitwiseOR(S.FLAG_DUE)).otherwise(flags.bitwiseAND(~S.FLAG_DUE)))


def members(ids: DataFrame, cards: DataFrame) -> DataFrame:
    """``ids`` (card key) with ``present``."""
    there = cards.select(*CARD).distinct().withColumn("there", F.lit(True))
    return ids.join(there, CARD, "left").withColumn("present", F.coalesce("there", F.lit(False))).drop("there")


def missing_recall(cards: DataFrame) -> DataFrame:
    """(learner_id, card_id): recognition cards whose recall card is missing."""
    side = lambda d: cards.where(F.col("deck") == d).select("learner_id", "card_id")
    return side("recog").join(side("recall"), ["learner_id", "card_id"], "left_anti")


def restrict(cards: DataFrame, custom: DataFrame) -> DataFrame:
    """Cards of the entries of a custom deck; an empty one does not restrict. Whether it is empty is a scalar subquery."""
    wanted = custom.select(F.col("ent_seq").alias("card_id")).distinct()
    n = custom.agg(F.count(F.lit(1))).scalar()
    marked = cards.join(wanted.withColumn("inside", F.lit(True)), "card_id", "left")
    return marked.where(F.col("inside") | (n == 0)).select(*cards.columns)


#: Filters of the library: the states that each lets through.
FILTERS = {"All": None, "New": (S.NEW,), "Learning": (S.LEARNING, S.RELEARNING), "Review": (S.REVIEW,), "Suspended": (S.SUSPENDED,)}


def passes(name: str, *states: Column) -> Column:
    """Whether either deck's state passes the library filter."""
    wanted = FILTERS[name]
    out = F.lit(wanted is None)
    for s in states:
        out = out | (F.coalesce(s.isin(*wanted), F.lit(False)) if wanted else s.isNotNull())
    return out


def active_codes(text: Column, known: Column) -> Column:
    """Known language codes of a comma list, trimmed; others are ignored."""
    return F.array_intersect(F.transform(F.split(text, ","), lambda t: F.trim(t)), known)


def valid_parameters(params: DataFrame) -> DataFrame:
    """Per-learner parameters with values out of range at their defaults."""
    keep = lambda c, ok, default: F.when(ok, F.col(c)).otherwise(F.lit(default)).alias(c)
    steps = lambda c, default: F.when(F.size(S.parse_steps(F.col(c))) > 0, F.col(c)).otherwise(default).alias(c)
    at = F.col
    return params.select(
        "learner_id",
        keep("retention", at("retention").between(0.7, 0.97), 0.9), keep("maximum_interval", at("maximum_interval") > 0, 36_500),
        keep("new_per_day", at("new_per_day") >= 0, 20), keep("reviews_per_day", at("reviews_per_day") >= 0, 200),
        keep("leech_threshold", at("leech_threshold") >= 1, 8), keep("day_offset", at("day_offset").between(0, 86_399), 14_400),
        steps("learning_steps", "1m 10m"), steps("relearning_steps", "10m"),
        keep("max_results", at("max_results").between(1, 90_000), 20_000),
        F.when(at("page_size") > 100, 100).when(at("page_size") >= 1, at("page_size")).otherwise(20).alias("page_size"),
        keep("order_mode", at("order_mode").between(0, 2), 0),
    )
