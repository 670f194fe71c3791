"""Golden values of the text functions, worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.functions import vocabulary as V

ROMAJI = {
    "toukyou": "とうきょう", "konna": "こんあ", "kippu": "きっぷ", "kon'na": "こんな", "shin'ichi": "しんいち", "nihongo": "にほんご", "fu": "fう",
    "wi": "んぃ", "tchi": "tち", "コーヒー": "こーひー", "a-b": "あ-b", "日本go": "日本ご", "": "", "n": "ん", "kkka": "っっか", "kya": "きゃ",
}
LONG = {"ああああ": ("あーあー", True), "おおきい": ("おーきー", True), "とうきょう": ("とうきょう", False), "": ("", False)}


def one(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, q string").select("i", column(F.col("q")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_romaji(spark):
    assert len(X.romaji_table()) == 158
    assert dict(zip(ROMAJI, one(spark, list(ROMAJI), X.to_hiragana), strict=True)) == ROMAJI
    assert one(spark, ["fu", "a-", "wi"], lambda q: X.to_hiragana(q, "extended")) == ["ふ", "あー", "うぃ"]


def walk(q):
    """A direct walk over the characters, to compare with the expression."""
    rows, out, i = X.romaji_table(), "", 0
    while i < len(q):
        two, c, after = q[i : i + 2], q[i], q[i + 1 : i + 2]
        if two in ("nn", "n'"):
            out, i = out + "ん", i + 2
        elif c == "n" and (not after or after not in "aiueoy"):
            out, i = out + "ん", i + 1
        elif c == after and "a" <= c <= "z" and c not in "aiueon":
            out, i = out + "っ", i + 1
        else:
            size = next((n for n in (3, 2, 1) if q[i : i + n] in rows and len(q[i : i + n]) == n), 0)
            out += rows[q[i : i + size]] if size else "" if c == "'" else chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c
            i += max(size, 1)
    return out


def test_romaji_against_a_walk(spark):
    r = random.Random(5)
    words = ["".join(r.choice("aiueonkstyhmrgzbpjcdfv'カー") for _ in range(r.randint(0, 12))) for _ in range(3000)]
    assert one(spark, words, X.to_hiragana) == [walk(w) for w in words]


def test_long_vowels(spark):
    assert one(spark, list(LONG), X.long_vowels) == [x for x, _ in LONG.values()]


def test_clean_scripts_and_grams(spark):
    assert one(spark, ["  AbÉ \t", "", "x"], X.clean_query) == ["abÉ", "", "x"]
    assert one(spark, ["漢", "かな", "abc", "漢a", "😀"], X.script_bits) == [1, 2, 4, 5, 4]
    assert one(spark, ["a😀bc", "ab", ""], lambda c: X.grams(c, 3)) == [["a😀b", "😀bc"], [], []]
    assert one(spark, ["ab", "abcd", ""], X.gloss_grams) == [["ab"], ["abc", "bcd"], []]
    assert one(spark, ["アイ", "あi"], X.japanese_grams) == [["ア", "イ", "アイ"], ["あ", "i", "あi"]]


def test_highlight(spark):
    span = lambda t: X.match_span(t, [F.lit("ねこ"), F.lit("いぬ")])
    assert one(spark, ["a<ネコ>", "いぬねこ", "none"], lambda t: X.highlight(t, span(t))) == ["a&lt;<b>ネコ</b>&gt;", "<b>いぬ</b>ねこ", "none"]


def test_references_and_readings(spark):
    split = one(spark, ["A・B・3", "A"], X.split_reference)
    assert [(r.primary, r.secondary) for r in split] == [("A", "B"), ("A", None)]
    rows = spark.createDataFrame([(["ネコ", "いぬ", "ねこ"],)], "r array<string>").select(X.first_readings(F.col("r")).alias("x")).first().x
    assert [(r.text, r.i) for r in rows] == [("ねこ", 0), ("いぬ", 1)]


@pytest.mark.parametrize(("kind", "size"), [("dial", 12), ("field", 96), ("ke_inf", 15), ("misc", 55), ("pos", 92), ("re_inf", 5), ("pri", 56)])
def test_vocabularies(kind, size):
    assert len(V.VOCABULARIES[kind]) == size


def test_tokens_and_languages(spark):
    assert one(spark, ["nf48", "news1", "nope"], lambda c: V.encode(c, "pri")) == [55, 0, None]
    assert one(spark, ["ger", "hak", "xyz", None], V.language_of) == ["de", "zh", "unk", "en"]
    assert V.tokens(spark).count() == 331
    assert V.languages(spark).count() == 28
