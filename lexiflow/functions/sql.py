"""The functions of this package by name in SQL: ``CREATE TEMPORARY FUNCTION ... RETURN``, which Spark inlines into plans as expressions.

After :func:`register`, a session's ``spark.sql`` knows ``to_hiragana``, ``long_vowels``, ``grams`` and the functions of days, texts and the memory model. A learner's parameters are
part of the definitions; registering again with others replaces them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import scheduling as S
from . import text as X
from .scheduling import Parameters


def _text(s: str) -> str:
    """A string literal of SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _within(value: str, bounds: tuple[float, float]) -> str:
    return f"greatest({_number(bounds[0])}, least({_number(bounds[1])}, {value}))"


def _interval(seconds: str) -> str:
    cases = (f"WHEN {seconds} >= {size} THEN concat(floor({seconds} / {size}), CASE WHEN floor({seconds} / {size}) = 1 THEN ' {one}' ELSE ' {many}' END)" for size, one, many in S.UNITS)
    return f"CASE {' '.join(cases)} ELSE '0 segundos' END"


def definitions(p: Parameters = Parameters(), table: str = "reference") -> dict[str, str]:
    """Name to ``(arguments) RETURNS type RETURN expression``."""
    w = [_number(x) for x in p.weights]
    rows = X.romaji_table(table)
    spellings = "|".join(s.replace("-", r"\-") for s in sorted(rows, key=lambda s: (-len(s), s)))
    known = ", ".join(f"{_text(a)}, {_text(b)}" for a, b in (rows | {"nn": "ん", "n'": "ん", "n": "ん", "'": ""}).items())
    tokens = "regexp_extract_all(regexp_replace(q, " + _text(r"([b-df-hj-mp-tv-z])(?=\1)") + ", 'っ'), " + _text(rf"(?s)nn|n'|n(?![aiueoy])|{spellings}|.") + ", 0)"
    fold = lambda c: f"translate({c}, '{X.KATAKANA}', '{X.HIRAGANA}')"
    long = "q"
    for vowel, row in X.VOWEL_ROWS.items():
        long = f"regexp_replace({long}, '([{row}]){vowel}', '$1ー')"
    unit = "map('s', 1, 'm', 60, 'h', 3600, 'd', 86400)"
    piece = _text(r"(\d+)([smhd])")
    seconds = f"transform(split(steps, ' +'), t -> try_element_at({unit}, regexp_extract(t, {piece}, 2)) * coalesce(try_cast(regexp_extract(t, {piece}, 1) AS INT), 0))"
    logical = lambda ts: f"CAST(CASE WHEN {ts} < {p.day_offset} THEN 0 ELSE floor(({ts} - {p.day_offset}) / {S.DAY}) END AS BIGINT)"
    start = lambda rating: _within(f"{w[4]} - exp({w[5]} * ({rating} - 1)) + 1.0D", S.DIFFICULTY)
    grown = f"exp({w[8]}) * (11.0D - difficulty) * pow(stability, -{w[9]}) * (exp({w[10]} * (1.0D - recall)) - 1.0D) * CASE rating WHEN {S.HARD} THEN {w[15]} WHEN {S.EASY} THEN {w[16]} ELSE 1.0D END"
    days = f"floor(9.0D * stability * ({_number(1.0 / p.retention)} - 1.0D) + 0.5D)"
    memory = "stability DOUBLE, difficulty DOUBLE, recall DOUBLE"
    return {
        "to_hiragana": f"(q STRING) RETURNS STRING RETURN {fold(f"array_join(transform({tokens}, t -> coalesce(try_element_at(map({known}), t), t)), '')")}",
        "long_vowels": f"(q STRING) RETURNS STRING RETURN {long}",
        "grams": "(text STRING, n INT) RETURNS ARRAY<STRING> RETURN coalesce(regexp_extract_all(text, concat('(?s)(?=(.{', n, '})).'), 1), CAST(array() AS ARRAY<STRING>))",
        "logical_day": f"(ts BIGINT) RETURNS BIGINT RETURN {logical('ts')}",
        "day_start": f"(day BIGINT) RETURNS BIGINT RETURN day * {S.DAY} + {p.day_offset}",
        "parse_steps": f"(steps STRING) RETURNS ARRAY<INT> RETURN filter({seconds}, s -> s > 0)",
        "interval_text": f"(seconds BIGINT) RETURNS STRING RETURN {_interval('seconds')}",
        "state_text": "(state INT) RETURNS STRING RETURN CASE state WHEN 0 THEN 'New' WHEN 1 THEN 'Learning' WHEN 2 THEN 'Review' WHEN 3 THEN 'Relearning' WHEN 4 THEN 'Suspended' ELSE 'Unknown' END",
        "due_text": f"(state INT, due_ts BIGINT, now BIGINT) RETURNS STRING RETURN CASE WHEN state = {S.NEW} THEN 'New' WHEN state = {S.SUSPENDED} THEN 'Suspended' WHEN due_ts <= now THEN 'Now' ELSE {_interval('(due_ts - now)')} END",
        "last_review_text": "(ts BIGINT) RETURNS STRING RETURN CASE WHEN ts > 0 THEN date_format(timestamp_seconds(ts), 'MMM d, yyyy') ELSE 'Never' END",
        "retrievability": f"(stability DOUBLE, elapsed BIGINT) RETURNS DOUBLE RETURN CASE WHEN stability <= 0 THEN 0.0D ELSE 1.0D / (1.0D + elapsed / {_number(S.DAY)} / (9.0D * stability)) END",
        "initial_stability": f"(rating INT) RETURNS DOUBLE RETURN greatest(element_at(array({', '.join(w[:4])}), greatest(1, least(4, rating))), 0.1D)",
        "initial_difficulty": f"(rating INT) RETURNS DOUBLE RETURN {start('rating')}",
        "short_stability": f"(stability DOUBLE, rating INT) RETURNS DOUBLE RETURN {_within(f'stability * exp({w[17]} * ((rating - 3) + {w[18]}))', S.STABILITY)}",
        "recall_stability": f"({memory}, rating INT) RETURNS DOUBLE RETURN {_within(f'stability * ({grown} + 1.0D)', S.STABILITY)}",
        "forget_stability": f"({memory}) RETURNS DOUBLE RETURN {_within(f'{w[11]} * pow(difficulty, -{w[12]}) * (pow(stability + 1.0D, {w[13]}) - 1.0D) * exp({w[14]} * (1.0D - recall))', S.STABILITY)}",
        "next_difficulty": f"(difficulty DOUBLE, rating INT) RETURNS DOUBLE RETURN {_within(f'{w[7]} * {start(S.EASY)} + (1.0D - {w[7]}) * (difficulty - {w[6]} * (rating - 3))', S.DIFFICULTY)}",
        "interval_days": f"(stability DOUBLE) RETURNS BIGINT RETURN CAST(CASE WHEN stability <= 0 THEN 1 ELSE greatest(1, least({p.maximum_interval}, {days})) END AS BIGINT)",
    }


def register(spark: SparkSession, p: Parameters = Parameters(), table: str = "reference") -> list[str]:
    """Make the functions known to the session; returns their names."""
    found = definitions(p, table)
    for name, rest in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
    return list(found)
