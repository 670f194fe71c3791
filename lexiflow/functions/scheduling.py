"""The arithmetic of the memory model, of days and of interval texts, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
NEW, LEARNING, REVIEW, RELEARNING, SUSPENDED = range(5)
AGAIN, HARD, GOOD, EASY = 1, 2, 3, 4
FLAG_LEECH, FLAG_MARKED, FLAG_DUE, FLAG_SNOOZED = 1, 2, 4, 8

# The default weights of the memory model and the bounds of its two quantities.
WEIGHTS = (
    0.4072, 1.1829, 3.1262, 7.2102, 7.2189, 0.5316, 1.0651, 0.0589, 1.5330, 0.14013,
    1.0070, 1.9395, 0.1100, 0.2900, 2.2700, 0.2500, 2.9898, 0.5100, 0.3400,
)
STABILITY, DIFFICULTY = (0.01, 36500.0), (1.0, 10.0)


@dataclass(frozen=True)
class Parameters:
    """What a learner can set. All of them take effect; steps are seconds."""

    weights: tuple[float, ...] = WEIGHTS
    retention: float = 0.9
    maximum_interval: int = 36_500
    leech_threshold: int = 8
    day_offset: int = 14_400
    new_per_day: int = 20
    reviews_per_day: int = 200
    learning_steps: tuple[int, ...] = field(default=(60, 600))
    relearning_steps: tuple[int, ...] = field(default=(600,))
    burst: int = 5
    fuzz: bool = False
    order_mode: str = "mixed"
    seed: int = 0


def _bounded(c: Column, bounds: tuple[float, float]) -> Column:
    return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), c))


def logical_day(ts: Column, p: Parameters) -> Column:
    """Days since the epoch, a day beginning ``day_offset`` seconds after midnight; 0 before the first."""
    return F.when(ts < p.day_offset, F.lit(0)).otherwise(F.floor((ts - p.day_offset) / DAY)).cast("long")


def day_start(day: Column, p: Parameters) -> Column:
    return (day * DAY + p.day_offset).cast("long")


def parse_steps(text: Column) -> Column:
    """``"1m 10m 2h"`` as seconds; tokens without number and unit, and zeros, are skipped."""
    unit = F.create_map(*[F.lit(x) for pair in (("s", 1), ("m", 60), ("h", 3600), ("d", DAY)) for x in pair])
    seconds = F.transform(F.split(text, " +"), lambda t: F.try_element_at(unit, F.regexp_extract(t, r"(\d+)([smhd])", 2)) * F.expr("int(1)") * F.coalesce(F.regexp_extract(t, r"(\d+)([smhd])", 1).try_cast("int"), F.lit(0)))
    return F.filter(seconds, lambda s: s > 0)


# Units of interval texts, with the seconds of one and its singular and plural.
UNITS = (
    (365 * DAY, "año", "años"), (30 * DAY, "mes", "meses"), (7 * DAY, "semana", "semanas"), (DAY, "día", "días"),
    (3600, "hora", "horas"), (60, "minuto", "minutos"), (1, "segundo", "segundos"),
)


def interval_text(seconds: Column) -> Column:
    """The number of the largest unit that fits, in words."""
    out = F.lit("0 segundos")
    for size, one, many in reversed(UNITS):
        n = F.floor(seconds / size).cast("long")
        out = F.when(seconds >= size, F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))).otherwise(out)
    return out


def state_text(state: Column) -> Column:
    names = ("New", "Learning", "Review", "Relearning", "Suspended")
    return F.coalesce(*[F.when(state == i, F.lit(n)) for i, n in enumerate(names)], F.lit("Unknown"))


def due_text(state: Column, due_ts: Column, now: Column) -> Column:
    return F.when(state == NEW, "New").when(state == SUSPENDED, "Suspended").when(due_ts <= now, "Now").otherwise(interval_text(due_ts - now))


def last_review_text(ts: Column) -> Column:
    return F.when(ts > 0, F.date_format(F.timestamp_seconds(ts), "MMM d, yyyy")).otherwise("Never")


def retrievability(stability: Column, elapsed: Column) -> Column:
    """Chance of recall ``elapsed`` seconds after the last review."""
    return F.when(stability <= 0, 0.0).otherwise(1.0 / (1.0 + elapsed / float(DAY) / (9.0 * stability)))


def initial_stability(rating: Column, p: Parameters) -> Column:
    w = F.array(*map(F.lit, p.weights[:4]))
    return F.greatest(F.element_at(w, F.greatest(F.lit(1), F.least(F.lit(4), rating)).cast("int")), F.lit(0.1))


def initial_difficulty(rating: Column, p: Parameters) -> Column:
    return _bounded(p.weights[4] - F.exp(p.weights[5] * (rating - 1)) + 1.0, DIFFICULTY)


def short_stability(stability: Column, rating: Column, p: Parameters) -> Column:
    return _bounded(stability * F.exp(p.weights[17] * ((rating - 3) + p.weights[18])), STABILITY)


def recall_stability(stability: Column, difficulty: Column, recall: Column, rating: Column, p: Parameters) -> Column:
    w = p.weights
    bonus = F.when(rating == HARD, w[15]).when(rating == EASY, w[16]).otherwise(1.0)
    growth = F.exp(F.lit(w[8])) * (11.0 - difficulty) * F.pow(stability, F.lit(-w[9])) * (F.exp(w[10] * (1.0 - recall)) - 1.0)
    return _bounded(stability * (growth * bonus + 1.0), STABILITY)


def forget_stability(stability: Column, difficulty: Column, recall: Column, p: Parameters) -> Column:
    w = p.weights
    return _bounded(w[11] * F.pow(difficulty, F.lit(-w[12])) * (F.pow(stability + 1.0, F.lit(w[13])) - 1.0) * F.exp(w[14] * (1.0 - recall)), STABILITY)


def next_difficulty(difficulty: Column, rating: Column, p: Parameters) -> Column:
    """A step by the rating, drawn a little towards where an easy start would be."""
    w = p.weights
    return _bounded(w[7] * initial_difficulty(F.lit(EASY), p) + (1.0 - w[7]) * (difficulty - w[6] * (rating - 3)), DIFFICULTY)


def interval_days(stability: Column, p: Parameters, key: Column | None = None) -> Column:
    """Days until recall falls to the wanted retention, rounded half up; ``key`` seeds the fuzz if that is on."""
    days = F.floor(9.0 * stability * (1.0 / p.retention - 1.0) + 0.5)
    days = F.when(stability <= 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(p.maximum_interval), days))).cast("long")
    return fuzz_interval(days, key, p) if p.fuzz and key is not None else days


def drawn(*parts: Column) -> Column:
    """A whole number of 52 bits from the MD5 of the parts, alike on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def fuzz_interval(days: Column, key: Column, p: Parameters) -> Column:
    """Intervals of a week or more vary by up to 5 %, by two days at most, and stay under the maximum."""
    varied = F.floor(days * (95 + drawn(F.lit(p.seed), key) % 11) / 100)
    near = F.greatest(days - 2, F.least(days + 2, varied))
    return F.when(days < 7, days).otherwise(F.least(F.lit(p.maximum_interval), near)).cast("long")


def fuzz_preview(days: Column, key: Column, p: Parameters) -> Column:
    """Previews vary by 15, 10 or 5 % according to size, by a day at least."""
    share = F.when(days < 7, 15).when(days < 30, 10).otherwise(5)
    by = F.greatest(F.lit(1), F.floor(days * share / 100))
    low = F.greatest(F.lit(1), days - by)
    varied = low + drawn(F.lit(p.seed), key) % (days + by - low + 1)
    return F.when(days < 2, days).otherwise(varied).cast("long")
