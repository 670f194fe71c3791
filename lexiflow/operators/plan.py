"""Study plans for all learners at once: queues, daily limits, order modes, the next card."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scheduling as S
from ..functions.scheduling import Parameters

DECK = ["learner_id", "deck"]


def queues(cards: DataFrame, now: int, p: Parameters = Parameters()) -> DataFrame:
    """Cards with ``queue`` (learn, review, new, later) and ``place`` in it, by due time and id; new cards come shuffled by a hash."""
    today = S.logical_day(F.lit(now), p)
    queue = (
        F.when(F.col("state") == S.NEW, "new").when(F.col("state").isin(S.LEARNING, S.RELEARNING), F.when(F.col("due_ts") <= now, "learn").otherwise("pending"))
        .when(F.col("state") == S.REVIEW, F.when(F.col("due_day") <= today, "review").otherwise("later"))
    )
    first = F.when(F.col("queue") == "new", S.drawn(F.lit(p.seed), F.col("card_id"))).otherwise(F.col("due_ts"))
    order = Window.partitionBy(*DECK, "queue").orderBy(first, "card_id")
    return cards.withColumn("queue", queue).where("queue is not null").withColumn("place", F.row_number().over(order) - 1)


def within_limits(queued: DataFrame, counters: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Queued cards less the new cards and reviews beyond today's limits; ``counters`` has new_done and review_done; 0 is no limit."""
    done = counters.select(*DECK, F.col("new_done").alias("n"), F.col("review_done").alias("r"))
    both = queued.join(done, DECK, "left")
    left = lambda limit, c: F.lit(True) if limit == 0 else F.col("place") < limit - F.coalesce(F.col(c), F.lit(0))
    ok = F.when(F.col("queue") == "new", left(p.new_per_day, "n")).when(F.col("queue") == "review", left(p.reviews_per_day, "r")).otherwise(True)
    return both.where(ok).drop("n", "r")


def ordered(queued: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Reviews and new cards with ``pos``, their order under the mode; mixed gives one new card after every burst of reviews."""
    some, burst = queued.where(F.col("queue").isin("review", "new")), p.burst or 5
    new = F.col("queue") == "new"
    keys = {
        "mixed": [F.when(new, F.col("place")).otherwise(F.floor(F.col("place") / burst)), new.cast("int"), F.col("place")],
        "review_first": [new.cast("int"), F.col("place")],
        "new_first": [(~new).cast("int"), F.col("place")],
    }[p.order_mode]
    return some.withColumn("pos", F.row_number().over(Window.partitionBy(*DECK).orderBy(*keys)) - 1)


def next_cards(queued: DataFrame, p: Parameters = Parameters(), sessions: DataFrame | None = None) -> DataFrame:
    """(learner_id, deck, card_id, queue, state, due_ts): the card that each deck serves next.

    Ready learning goes first, then reviews and new cards by mode, then learning that is not ready, then a future review. ``sessions``
    (cards_done, session_limit) closes decks whose limit is reached.
    """
    new_first = p.order_mode == "new_first"
    priority = (
        F.when(F.col("queue") == "learn", 0).when(F.col("queue") == "review", 2 if new_first else 1)
        .when(F.col("queue") == "new", 1 if new_first else 2).when(F.col("queue") == "pending", 3).otherwise(4)
    )
    if sessions is not None:
        closed = sessions.where("session_limit > 0 and cards_done >= session_limit").select(*DECK)
        queued = queued.join(closed, DECK, "left_anti")
    best = queued.groupBy(*DECK).agg(F.min_by(F.struct("card_id", "queue", "state", "due_ts"), F.struct(priority, "place")).alias("c"))
    return best.select(*DECK, "c.*")


def choose_deck(best: DataFrame, now: int) -> DataFrame:
    """(learner_id, deck, card_id, ...): of the decks' next cards the one to serve; ready learning, then due time, then recognition."""
    ready = F.col("state").isin(S.LEARNING, S.RELEARNING) & (F.col("due_ts") <= now)
    rest = [c for c in best.columns if c != "learner_id"]
    key = F.struct((~ready).cast("int"), "due_ts", (F.col("deck") != "recog").cast("int"))
    return best.groupBy("learner_id").agg(F.min_by(F.struct(*rest), key).alias("c")).select("learner_id", "c.*")


def next_filtered(cards: DataFrame, custom: DataFrame, now: int, p: Parameters = Parameters()) -> DataFrame:
    """(learner_id, deck, card_id): within a custom deck learning comes first, then by due time; reviews only when due."""
    inside = cards.join(custom.select(F.col("ent_seq").alias("card_id")).distinct(), "card_id", "left_semi")
    open_ = inside.where((F.col("state") != S.SUSPENDED) & ((F.col("state") != S.REVIEW) | (F.col("due_day") <= S.logical_day(F.lit(now), p))))
    key = F.struct((~F.col("state").isin(S.LEARNING, S.RELEARNING)).cast("int"), "due_ts", "card_id")
    return open_.groupBy(*DECK).agg(F.min_by("card_id", key).alias("card_id"))


def servable(cards: DataFrame, now: int, p: Parameters = Parameters()) -> DataFrame:
    """Cards that may be served: neither suspended nor future reviews."""
    return cards.where((F.col("state") != S.SUSPENDED) & ((F.col("state") != S.REVIEW) | (F.col("due_day") <= S.logical_day(F.lit(now), p))))


def wait_seconds(cards: DataFrame, now: int, p: Parameters = Parameters()) -> DataFrame:
    """(learner_id, wait): 0 when something can be served now, else the time to the earliest future card of any deck."""
    ready = (F.col("state") == S.NEW) | (F.col("state").isin(S.LEARNING, S.RELEARNING) & (F.col("due_ts") <= now)) | ((F.col("state") == S.REVIEW) & (F.col("due_day") <= S.logical_day(F.lit(now), p)))
    soon = F.min(F.when((F.col("state") != S.SUSPENDED) & (F.col("due_ts") > now), F.col("due_ts"))) - now
    return cards.groupBy("learner_id").agg(F.when(F.max(ready.cast("int")) == 1, 0).otherwise(F.coalesce(soon, F.lit(0))).cast("long").alias("wait"))
