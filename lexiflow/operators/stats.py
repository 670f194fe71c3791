"""Statistics of decks, learners and days; one partial aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scheduling as S
from ..functions.scheduling import Parameters


def _n(condition, name: str):
    return F.count_if(condition).alias(name)


def deck_statistics(cards: DataFrame, now: int, p: Parameters = Parameters()) -> DataFrame:
    """One row for each learner and deck. Means are over cards with a memory that are not suspended; mature is above 21 days."""
    today, state = S.logical_day(F.lit(now), p), F.col("state")
    alive = (F.col("stability") > 0) & (state != S.SUSPENDED)
    elapsed = F.when((F.col("last_review") > 0) & (F.col("last_review") < now), now - F.col("last_review")).otherwise(0)
    mean = lambda c, name: F.round(F.coalesce(F.avg(F.when(alive, c)), F.lit(0.0)), 6).alias(name)
    return cards.groupBy("learner_id", "deck").agg(
        F.count(F.lit(1)).alias("total"), _n(state == S.NEW, "new_count"), _n(state == S.LEARNING, "learning_count"), _n(state == S.RELEARNING, "relearning_count"),
        _n(state == S.REVIEW, "review_count"), _n(state == S.SUSPENDED, "suspended_count"), _n(F.col("flags").bitwiseAND(S.FLAG_LEECH) > 0, "leech_count"),
        _n(F.col("lapses") > 0, "cards_with_lapses"), _n(F.col("due_day") <= today, "due_now_all"), _n((F.col("due_day") <= today) & (state != S.SUSPENDED), "due_now_active"),
        _n(F.col("due_day") == today, "due_today"), mean(F.col("stability"), "average_stability"), mean(F.col("difficulty"), "average_difficulty"),
        mean(S.retrievability(F.col("stability"), elapsed), "retention"), _n(alive & (F.col("stability") > 21), "mature_count"), _n(alive & (F.col("stability") <= 21), "young_count"),
    )


def dashboard(cards: DataFrame, now: int, p: Parameters = Parameters()) -> DataFrame:
    """Counts of each learner over both decks."""
    state = F.col("state")
    return cards.groupBy("learner_id").agg(
        F.count(F.lit(1)).alias("total"), _n((F.col("due_day") <= S.logical_day(F.lit(now), p)) & (state != S.SUSPENDED), "due"),
        _n(state.isin(S.LEARNING, S.RELEARNING), "learning"), _n(state == S.NEW, "new"), _n(F.col("lapses") > 0, "lapsed"),
    )


def day_counters(answers: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(learner_id, deck, day, new_done, learn_done, review_done, cards_done): answers by the state that the card was in (prev_state)."""
    before = F.col("prev_state")
    return answers.withColumn("day", S.logical_day(F.col("ts"), p)).groupBy("learner_id", "deck", "day").agg(
        _n(before == S.NEW, "new_done"), _n(before.isin(S.LEARNING, S.RELEARNING), "learn_done"), _n(before == S.REVIEW, "review_done"), F.count(F.lit(1)).alias("cards_done"),
    )


def total_answers(events: DataFrame) -> DataFrame:
    return events.groupBy("learner_id", "deck", "card_id").agg(_n(F.col("type") == "review", "total_answers"))
