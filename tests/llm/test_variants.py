"""Near words against all pairs, on words that are hard for the gram index, and the whole query against plain code."""

import random
import re
import zlib
from collections import Counter

import pytest

from lexiflow.llm import variants as V

SF = "/root/testdata/sf0.001"


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def pairs_of(words: set[str]) -> set[tuple[str, str]]:
    """All pairs one edit apart, by what is left of each word without one letter: equal remains are then compared in full."""
    remains: dict[str, set[str]] = {}
    for w in words:  # a word of n letters has n + 1 of these
        for r in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            remains.setdefault(r, set()).add(w)
    return {(a, b) for group in remains.values() for a in group for b in group if a < b and one_edit(a, b)}


def edited(word: str, rng: random.Random, letters: str) -> str:
    i, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    if kind == 0:
        return word[:i] + rng.choice(letters) + word[i:]
    i = min(i, len(word) - 1)
    return word[:i] + (rng.choice(letters) if kind == 1 else "") + word[i + 1 :]


@pytest.mark.parametrize("letters, most", [("ab", 1), ("ab", 7), ("abcde", 3), ("abcde", 40), ("abcdefghijklmnopqrstuvwxyzäö", 40_000), ("aé", 1_000)])
def test_pairs_against_all(spark, letters, most):
    rng = random.Random(len(letters) * most)
    words = set()
    for _ in range(250):
        w = "".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 7, 8, 8, 9, 10, 11, 12, 13, 14, 17, 40, 63, 64, 65, 66])))
        words |= {w, edited(w, rng, letters), edited(edited(w, rng, letters), rng, letters)}
    words |= {"a" * k for k in range(5, 20)}
    words = {w for w in words if len(w) >= 7}
    got = {(r.a, r.b) for r in V.near_pairs(spark.createDataFrame([(w,) for w in [*words, "short", None]], "word string"), most).collect()}
    assert got == pairs_of(words) and len(got) > 20


def test_an_edit_leaves_one_gram_of_the_pair():
    """The bound itself: whatever the edit, one of the two grams is a gram of the other word, where it is looked for."""
    rng = random.Random(5)
    for _ in range(3000):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        w = "".join(rng.choice(letters) for _ in range(rng.choice([*range(7, 20), 63, 64, 65, 66])))
        other = edited(w, rng, letters)
        if len(other) < len(w):
            w, other = other, w
        if other == w or len(w) < 7:
            continue
        grams = [x for k in range(2, 7) for x in {s[i : i + k] for s in (w, other) for i in range(len(s) - k + 1)}]
        frequent = {}
        for g in grams:  # any set that holds the beginnings of its members
            if (len(g) == 2 or g[:-1] in frequent) and rng.random() < 0.7:
                frequent[g] = rng.randrange(2, 9)
        key = lambda word, r: (len(word) - (r[1] if not r[0] else 0), len(word) + (r[1] if r[0] else 0), *r[2:], word[: r[2]], word[len(word) - r[3] :])
        asked = {key(w, r) for r in V.index_rows(w, frequent, 1) if r[0]}
        listed = {key(other, r) for r in V.index_rows(other, frequent, 1) if not r[0]}
        assert asked & listed, (w, other)


def test_dictionary_is_bounded(spark):
    words = spark.createDataFrame([("banana" * 2,), ("bananas",), ("cabanas",)], "word string")
    frequent, rare = V.gram_counts(words, 8)
    assert rare == 4 and frequent == {"an": 8, "na": 6 + 1, "ana": 6} or max(frequent.values()) > rare
    assert V.gram_counts(words.where("false"), 8) == ({}, 0)
    assert V.decompose("banana", {"an": 3, "ana": 2}, 4) == [(0, 2), (1, 5), (3, 6)]


def brute(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near: dict[str, list[str]] = {w: [] for w in n}
    for a, b in pairs_of(set(n)):
        near[a].append(b)
        near[b].append(a)
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return out


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.doc_id, r.text) for r in docs])
    got = V.op12_spelling_variants(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == want and any(w[1] for w in want)


def test_chains_ties_and_unusual_rows(spark):
    rows = [("abcdefg", 1), ("abcdefgh", 12), ("abcdefghi", 150), ("abcdefghij", 150 * 9), ("zzzzzzz", 2), ("zzzzzzy", 20), ("zzzzzzx", 20), ("x" * 100_000, 3), ("x" * 100_001, 40), ("Ünïcödé", 5), ("Ünïcöde", 50), ("tooshor", 2)]
    got = {r.word: (r.form, r.root, r.n_near) for r in V.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghi", 1) and got["abcdefghi"] == (None, "abcdefghi", 2)
    assert got["zzzzzzz"] == ("zzzzzzx", "zzzzzzx", 2) and got["x" * 100_000][1] == "x" * 100_001
    assert got["Ünïcödé"] == ("Ünïcöde", "Ünïcöde", 1) and got["tooshor"] == (None, "tooshor", 0)
    assert V.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_words_of_unusual_rows(spark):
    long = "Wonderful ÀÉÎÕÜÿ× " * 40_000
    rows = [(1, None, "m"), (2, "", "m"), (3, long, "m"), (3, long, "m"), (None, "Wonderful", "m"), (4, "1234567 abc-def", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").withColumn("h", V.F.lit("mine"))
    got = {r.word: r.n for r in V.noisy_words(docs).collect()}
    want = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 7}
    assert V.noisy_words(docs.where("false")).count() == 0
