"""The SQL functions against the column functions, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import scheduling as S
from lexiflow.functions import sql as Q
from lexiflow.functions import text as X
from lexiflow.functions.scheduling import Parameters


@pytest.mark.parametrize("p", [Parameters(), Parameters(retention=0.8, maximum_interval=50, day_offset=0)])
def test_numbers(spark, p):
    names = Q.register(spark, p)
    assert len(names) == 18
    r = random.Random(1)
    rows = [(r.choice([0.0, -1.0, r.uniform(0.001, 400)]), r.uniform(1, 10), r.random(), r.randint(1, 4), r.randint(0, 2_000_000_000), r.randint(0, 6)) for _ in range(300)]
    spark.createDataFrame(rows, "s double, d double, q double, r int, t long, k int").createOrReplaceTempView("numbers")
    c = F.col
    pairs = {
        "logical_day(t)": S.logical_day(c("t"), p), "day_start(k)": S.day_start(c("k").cast("long"), p), "interval_text(t)": S.interval_text(c("t")), "state_text(k)": S.state_text(c("k")),
        "due_text(k, t, 1000000000)": S.due_text(c("k"), c("t"), F.lit(1_000_000_000)), "last_review_text(t)": S.last_review_text(c("t")), "retrievability(s, t)": S.retrievability(c("s"), c("t")),
        "initial_stability(r)": S.initial_stability(c("r"), p), "initial_difficulty(r)": S.initial_difficulty(c("r"), p), "short_stability(abs(s), r)": S.short_stability(F.abs("s"), c("r"), p),
        "recall_stability(abs(s) + 1, d, q, r)": S.recall_stability(F.abs("s") + 1, c("d"), c("q"), c("r"), p), "forget_stability(abs(s), d, q)": S.forget_stability(F.abs("s"), c("d"), c("q"), p),
        "next_difficulty(d, r)": S.next_difficulty(c("d"), c("r"), p), "interval_days(s)": S.interval_days(c("s"), p),
    }
    for text, column in pairs.items():
        got = [x[0] for x in spark.sql(f"SELECT {text} FROM numbers ORDER BY t, s").collect()]
        want = [x[0] for x in spark.table("numbers").orderBy("t", "s").select(column).collect()]
        assert got == (pytest.approx(want, abs=1e-12) if isinstance(want[0], float) else want), text


def test_texts(spark):
    Q.register(spark)
    words = ["toukyou", "kippu", "shin'ichi", "konna", "kon'na", "コーヒー", "日本go", "ああああ", "おおきい", "1m 10m", "5h bad 2d", "", "a'b\\c", "𝄞xyz", None]
    spark.createDataFrame([(w,) for w in words], "w string").createOrReplaceTempView("words")
    table = spark.table("words")
    for text, column in {"to_hiragana(w)": X.to_hiragana(F.col("w")), "long_vowels(w)": X.long_vowels(F.col("w")), "grams(w, 2)": X.grams(F.col("w"), 2), "parse_steps(w)": S.parse_steps(F.col("w"))}.items():
        assert spark.sql(f"SELECT {text} FROM words").collect() == table.select(column).collect(), text
    Q.register(spark, table="extended")
    assert spark.sql("SELECT to_hiragana('fu-')").first()[0] == "ふー"


def test_plans_have_expressions_only(spark, capsys):
    Q.register(spark)
    spark.sql("SELECT interval_days(recall_stability(id + 1, 5.0D, 0.9D, 3)) AS d, to_hiragana(string(id)) AS h FROM range(10) WHERE logical_day(id) = 0").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "interval_days" not in plan and "greatest" in plan
