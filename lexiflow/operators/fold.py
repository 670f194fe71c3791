"""The fold of a card's history with carried state: one row at a time, in order, however long the history is.

Batch replay of cards with very many reviews and the streaming card state use it. What is held for a card is its state, and for undo a bounded
number of earlier ones; ``replay.answer`` is the same step as column expressions, for histories that fit a row.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa

from ..functions import scheduling as S
from ..functions.scheduling import Parameters

#: Answers that undo can take back once they are settled. What it would take back beyond is told apart.
UNDO_DEPTH = 64


class Card(NamedTuple):
    """A card's state, with the fields and the order of ``replay.STATE``."""

    state: int = S.NEW
    step: int = 0
    stability: float = 0.0
    difficulty: float = S.DIFFICULTY[0]
    reps: int = 0
    lapses: int = 0
    flags: int = 0
    due_ts: int = 0
    due_day: int = 0
    last_review: int = 0
    total_answers: int = 0
    prev_state: int = 0


def _bounded(x: float, bounds: tuple[float, float]) -> float:
    return max(bounds[0], min(bounds[1], x))


def _logical_day(ts: int, p: Parameters) -> int:
    return 0 if ts < p.day_offset else (ts - p.day_offset) // S.DAY


def _initial_difficulty(rating: int, p: Parameters) -> float:
    return _bounded(p.weights[4] - math.exp(p.weights[5] * (rating - 1)) + 1.0, S.DIFFICULTY)


def _stability(card: Card, rating: int, ts: int, p: Parameters) -> float:
    w, s, d = p.weights, card.stability, card.difficulty
    if card.state == S.NEW:
        return max(w[max(1, min(4, rating)) - 1], 0.1)
    if card.state in (S.LEARNING, S.RELEARNING):
        return _bounded(s * math.exp(w[17] * ((rating - 3) + w[18])), S.STABILITY)
    elapsed = ts - card.last_review if 0 < card.last_review < ts else 0
    lost = 1.0 - (0.0 if s <= 0 else 1.0 / (1.0 + elapsed / float(S.DAY) / (9.0 * s)))
    if rating == S.AGAIN:
        return _bounded(w[11] * d ** -w[12] * ((s + 1.0) ** w[13] - 1.0) * math.exp(w[14] * lost), S.STABILITY)
    bonus = {S.HARD: w[15], S.EASY: w[16]}.get(rating, 1.0)
    return _bounded(s * (math.exp(w[8]) * (11.0 - d) * s ** -w[9] * (math.exp(w[10] * lost) - 1.0) * bonus + 1.0), S.STABILITY)


def _days(stability: float, p: Parameters, seed: str) -> int:
    days = 1 if stability <= 0 else max(1, min(p.maximum_interval, math.floor(9.0 * stability * (1.0 / p.retention - 1.0) + 0.5)))
    if not p.fuzz or days < 7:
        return days
    drawn = int(hashlib.md5(f"{p.seed}:{seed}".encode()).hexdigest()[:13], 16)
    return min(p.maximum_interval, max(days - 2, min(days + 2, days * (95 + drawn % 11) // 100)))


def answered(card: Card, rating: int, ts: int, p: Parameters, key: int | str = "") -> Card:
    """The card after one answer; ``key`` seeds the fuzz."""
    if card.state == S.SUSPENDED:
        return card._replace(last_review=ts, total_answers=card.total_answers + 1, flags=card.flags & ~S.FLAG_SNOOZED)
    new, again = card.state == S.NEW, rating == S.AGAIN
    lapse = card.state == S.REVIEW and again
    relearning = lapse or card.state == S.RELEARNING
    stability = _stability(card, rating, ts, p)
    if new:
        difficulty = _initial_difficulty(rating, p)
    else:
        w = p.weights
        difficulty = _bounded(w[7] * _initial_difficulty(S.EASY, p) + (1.0 - w[7]) * (card.difficulty - w[6] * (rating - 3)), S.DIFFICULTY)
    steps = p.relearning_steps if relearning else p.learning_steps
    # the step that comes next, and whether the steps are behind
    if again:
        step = 0
    elif new:
        step = int(rating == S.GOOD)
    else:
        step = card.step + (int(rating >= S.GOOD) if card.state == S.LEARNING else 1)
    leaves = not steps if lapse else card.state == S.REVIEW or not again and (rating == S.EASY or step >= len(steps))
    reps, lapses = (0, 0) if new else (card.reps + int(leaves and not lapse), card.lapses + int(lapse))
    if new and leaves:
        reps = 1
    flags = card.flags & ~S.FLAG_SNOOZED
    if lapse and 0 < p.leech_threshold <= lapses:
        flags |= S.FLAG_LEECH
    if leaves:
        day = _logical_day(ts, p) + _days(stability, p, f"{key}:{card.total_answers}")
        due, state, step = day * S.DAY + p.day_offset, S.REVIEW, 0 if new else card.step
    else:
        due = ts + (steps[step] if step < len(steps) else 600 if relearning else 60)
        day, state = _logical_day(due, p), S.RELEARNING if relearning else S.LEARNING
    return Card(state, step, stability, difficulty, reps, lapses, flags, due, day, ts, card.total_answers + 1, card.prev_state)


class Ledger:
    """A card with what undo can bring back: the states before its last answers, ``depth`` at most, and how many lie deeper."""

    def __init__(self, card: Card = Card(), before: Iterable[Card] = (), deeper: int = 0, lost: bool = False, depth: int = UNDO_DEPTH):
        self.card, self.before, self.deeper, self.lost, self.depth = card, deque(before), deeper, lost, depth

    def copy(self) -> Ledger:
        return Ledger(self.card, self.before, self.deeper, self.lost, self.depth)

    def answer(self, rating: int, ts: int, p: Parameters, key: int | str = "") -> None:
        self.before.append(self.card)
        if len(self.before) > self.depth:
            self.before.popleft()
            self.deeper += 1
        self.card = answered(self.card, rating, ts, p, key)

    def undo(self) -> None:
        """Back to the state before the last answer that is not taken back; nothing if there is none. ``lost`` tells that there is one, but too deep."""
        if self.before:
            self.card = self.before.pop()
        elif self.deeper:
            self.lost = True


def fold_sorted(batches: Iterator[pa.RecordBatch], keys: int, p: Parameters) -> Iterator[tuple]:
    """(key values, state fields) of each card, for batches whose rows come card by card and in order.

    Columns: ``keys`` key columns, card_key, rating, ts, then the state fields. A row with a state sets it; the others are answers. One card is held at a time.
    """
    at, card = None, Card()
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for key, seed, rating, ts, begin in zip(zip(*columns[:keys], strict=True), *columns[keys : keys + 3], zip(*columns[keys + 3 :], strict=True), strict=True):
            if key != at:
                if at is not None:
                    yield (*at, *card)
                at, card = key, Card()
            card = answered(card, rating, ts, p, seed) if begin[0] is None else Card(*begin)
    if at is not None:
        yield (*at, *card)
