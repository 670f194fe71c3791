"""Cleaning, scripts, kana and n-grams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Katakana with a hiragana counterpart, U+30A1 to U+30F6, and their counterparts 0x60 below.
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))

# Romaji spellings and their kana, row by row.
ROMAJI_ROWS = """
a あ i い u う e え o お
ka か ki き ku く ke け ko こ kya きゃ kyu きゅ kyo きょ kwa くぁ kwi くぃ kwe くぇ kwo くぉ
ga が gi ぎ gu ぐ ge げ go ご gya ぎゃ gyu ぎゅ gyo ぎょ gwa ぐぁ gwi ぐぃ gwe ぐぇ gwo ぐぉ
sa さ shi し si し su す se せ so そ sha しゃ shu しゅ sho しょ she しぇ
ta た chi ち ti てぃ tsu つ tu とぅ te て to と cha ちゃ chu ちゅ cho ちょ che ちぇ tsa つぁ tsi つぃ tse つぇ tso つぉ
da だ de で do ど di でぃ du どぅ dji ぢ dya でゃ dyu でゅ dyo でょ
fa ふぁ fi ふぃ fe ふぇ fo ふぉ fya ふゃ fyu ふゅ fyo ふょ
vu ゔ va ゔぁ vi ゔぃ ve ゔぇ vo ゔぉ vya ゔゃ vyu ゔゅ vyo ゔょ
ja じゃ ji じ ju じゅ jo じょ je じぇ
tha てぁ thi てぃ thu てぅ the てぇ tho てぉ dha でぁ dhi でぃ dhu でぅ dhe でぇ dho でぉ
ha は hi ひ hu ふ he へ ho ほ hya ひゃ hyu ひゅ hyo ひょ
ba ば bi び bu ぶ be べ bo ぼ bya びゃ byu びゅ byo びょ
pa ぱ pi ぴ pu ぷ pe ぺ po ぽ pya ぴゃ pyu ぴゅ pyo ぴょ
ma ま mi み mu む me め mo も mya みゃ myu みゅ myo みょ
ya や yu ゆ yo よ
ra ら ri り ru る re れ ro ろ rya りゃ ryu りゅ ryo りょ
wa わ wi んぃ we んぇ wo を
n ん na な ni に nu ぬ ne ね no の nya にゃ nyu にゅ nyo にょ
za ざ zi じ zu ず ze ぜ zo ぞ zya じゃ zyu じゅ zyo じょ dzu づ
"""
#: Spellings that the rows lack or give oddly; used with ``table="extended"``.
ROMAJI_FIXES = "fu ふ wi うぃ we うぇ - ー"

# Kana by the vowel they end in, for the long-vowel variant.
VOWEL_ROWS = {
    "あ": "ぁあかがさざただなはばぱまゃやらわ",
    "い": "ぃいきぎしじちぢにひびぴみり",
    "う": "ぅうくぐすずつづぬふぶぷむゅゆるゔ",
    "え": "ぇえけげせぜてでねへべぺめれ",
    "お": "ぉおこごそぞとどのほぼぽもょよろを",
}


def romaji_table(table: str = "reference") -> dict[str, str]:
    """Spelling to kana."""
    words = ROMAJI_ROWS.split()
    rows = dict(zip(words[::2], words[1::2], strict=True))
    if table == "extended":
        more = ROMAJI_FIXES.split()
        rows |= dict(zip(more[::2], more[1::2], strict=True))
    return rows


def clean_query(q: Column) -> Column:
    """Trim white space at both ends and lower-case A-Z only."""
    return F.translate(F.regexp_replace(q, r"^[ \t-\r]+|[ \t-\r]+$", ""), UPPER, LOWER)


def fold_kana(c: Column) -> Column:
    """Katakana to hiragana, character by character."""
    return F.translate(c, KATAKANA, HIRAGANA)


def to_hiragana(q: Column, table: str = "reference") -> Column:
    """Romaji, kana or a mix to hiragana: longest spelling first, ``n`` before a consonant is ん, a doubled consonant っ.

    No spelling has a doubled consonant inside, so doubled ones can be replaced first.
    """
    rows = romaji_table(table)
    spellings = "|".join(s.replace("-", r"\-") for s in sorted(rows, key=lambda s: (-len(s), s)))
    doubled = F.regexp_replace(q, r"([b-df-hj-mp-tv-z])(?=\1)", "っ")
    tokens = F.regexp_extract_all(doubled, F.lit(rf"(?s)nn|n'|n(?![aiueoy])|{spellings}|."), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in (rows | {"nn": "ん", "n'": "ん", "n": "ん", "'": ""}).items() for x in pair])
    return fold_kana(F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), t)), ""))


def long_vowels(q: Column) -> Column:
    """A vowel that repeats the vowel of the kana before it becomes ー; pairs are taken from the left."""
    for vowel, row in VOWEL_ROWS.items():
        q = F.regexp_replace(q, f"([{row}]){vowel}", "$1ー")
    return q


def same_kana(a: Column, b: Column) -> Column:
    return fold_kana(a) == fold_kana(b)


def kana_position(text: Column, pattern: Column) -> Column:
    """First place (from 0) of ``pattern`` in ``text`` without regard to the kana script; -1 if there is none or it is empty."""
    return F.when(pattern == "", -1).otherwise(F.instr(fold_kana(text), fold_kana(pattern)) - 1)


def script_bits(c: Column) -> Column:
    """1 for a kanji, 2 for a kana, 4 for any character that is not three bytes long in UTF-8."""
    bit = lambda pattern, n: F.when(c.rlike(pattern), n).otherwise(0)
    return bit(r"[\u4E00-\u9FAF]", 1) + bit(r"[\u3040-\u30FF]", 2) + bit(r"[\u0000-\u07FF\x{10000}-\x{10FFFF}]", 4)


def grams(c: Column, n: int) -> Column:
    """All runs of n code points, in order; empty if the text is shorter.

    One pass of a regular expression that looks n code points ahead and goes on by one, so it is linear in the text.
    """
    return F.coalesce(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), 1), F.array().cast("array<string>"))


def japanese_grams(c: Column) -> Column:
    return F.concat(grams(c, 1), grams(c, 2), grams(c, 3))


def gloss_grams(c: Column) -> Column:
    """Runs of three code points, or the whole of a shorter text."""
    return F.when(F.length(c) >= 3, grams(c, 3)).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def grams_for(c: Column, kind: Column) -> Column:
    """The grams that the index of this kind has: glosses one length, Japanese forms three."""
    return F.when(kind == "gloss", gloss_grams(c)).otherwise(japanese_grams(c))


def first_readings(readings: Column) -> Column:
    """(text, i): folded readings, the first of equal ones with its place in the entry."""
    folded = F.transform(readings, lambda r, i: F.struct(fold_kana(r).alias("text"), i.alias("i")))
    texts = F.transform(readings, fold_kana)
    return F.filter(folded, lambda x: F.array_position(texts, x["text"]) == x["i"] + 1)


def split_reference(target: Column) -> Column:
    """(primary, secondary): the parts before and after the first middle dot; later parts do not matter."""
    parts = F.split(target, "・")
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("primary"), F.try_element_at(parts, F.lit(2)).alias("secondary"))


def escape_html(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def match_span(text: Column, variants: list[Column]) -> Column:
    """(start, size) of the earliest variant in the text; of those at one place the first; null if none matches."""
    spans = [F.when(kana_position(text, v) >= 0, F.struct(kana_position(text, v).alias("start"), F.lit(k).alias("k"), F.length(v).alias("size"))) for k, v in enumerate(variants)]
    best = F.array_min(F.array(*spans)) if len(spans) > 1 else spans[0]
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), best["size"].alias("size")))


def highlight(text: Column, span: Column) -> Column:
    """The escaped text with the span in bold."""
    part = lambda a, n: escape_html(F.substr(text, a, n))
    start = span["start"].cast("int")
    marked = F.concat(part(F.lit(1), start), F.lit("<b>"), part(start + 1, span["size"]), F.lit("</b>"), part(start + 1 + span["size"], F.length(text)))
    return F.when(span.isNull(), escape_html(text)).otherwise(marked)
