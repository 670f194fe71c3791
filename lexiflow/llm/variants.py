"""Spelling variants: words that differ by one edit, found through a variable-length gram index.

1. A gram dictionary is counted over the distinct words: grams of 2 to 6 letters, pruned by frequency. A gram is longer than 2 letters only if what it extends is
   frequent, so no list of the index is long unless its gram has the greatest length.
2. A word is decomposed into variable grams: at each place the longest gram of the dictionary, unless an earlier one covers it.
3. Affected grams: with grams of at most q letters, an edit at letter i can change only grams that end in i to i + q. Of two grams whose ends lie more than q apart one
   outlives any single edit, at a known place: the earlier one where it was, and all letters up to it with it, or the later one, moved by the change of length,
   with all letters behind it. So each word merges just the lists of two grams, the rarest such pair, and loses no near word. What an edit spares is cut once more: of the other
   side of the word, which has the edit, either the first or the last half is as it was. Lists are told apart by length, place, and all letters spared.
4. Members of these lists are verified by their edit distance.

Words of over 64 letters are few and long: they have two grams only, their halves, of which any edit leaves one.

For q letters the pair exists in words of 2 q + 1 letters or more, since the first gram ends at q or before and the last one at the end of the word. The greatest gram of a word
is therefore (letters - 1) / 2, within 3 to 6; a word is indexed for its own length and for that of words one letter shorter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, documents, staged, tidy

#: Letters of the shortest and of the longest gram.
SHORTEST, LONGEST = 2, 6
#: Grams of one length in the dictionary that goes to all tasks, at most: those that more than 1 / DICTIONARY of all places have.
DICTIONARY = 40_000
#: Words shorter than this are not compared.
LEAST_LETTERS = 7
#: Words longer than this are indexed by their halves, so that no word has many rows as long as itself.
LONG = 64
#: A form is this many times as frequent as its variant.
FACTOR = 10
#: One run in so many loses a letter in :func:`noisy_words`.
NOISE = 31


def widest(letters: int) -> int:
    """The length of the longest grams for words of so many letters."""
    return min(LONGEST, (letters - 1) // 2)


def halves(word: str, letters: int) -> list[tuple[int, int]]:
    """The first and the last part of a word, as long as the halves of a word of so many letters."""
    return [(0, letters // 2), (len(word) - (letters - letters // 2), len(word))]


def gram_counts(words: DataFrame, most: int = DICTIONARY) -> tuple[dict[str, int], int]:
    """The frequent grams of the distinct words with their counts, and the count up to which a gram is rare.

    A gram is frequent if more than ``1 / most`` of all places of its length hold it, so there are at most ``most`` of each length whatever the words.
    """
    words = words.where(F.length("word") <= LONG + 1)
    lengths = F.explode(F.sequence(F.lit(SHORTEST), F.lit(LONGEST))).alias("k")
    places = words.select("word", lengths).where(F.length("word") >= F.col("k"))
    grams = places.select("word", "k", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("k") + 1)).alias("at"))
    total = words.select(F.sum(F.length("word").cast("long")).alias("n")).first()["n"] or 0
    rare = -(-total // most)
    found = grams.groupBy(F.substring("word", F.col("at"), F.col("k")).alias("gram")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rare)
    return {r["gram"]: r["n"] for r in found.toLocalIterator()}, rare


def decompose(word: str, frequent: dict[str, int], q: int) -> list[tuple[int, int]]:
    """(start, end) of the variable grams of a word: each place's longest gram that is frequent but for its last letter, less those inside an earlier one."""
    out, covered, size = [], 0, len(word)
    for start in range(size - SHORTEST + 1):
        end, last = start + SHORTEST, min(size, start + q)
        while end < last and word[start:end] in frequent:
            end += 1
        if end > covered:
            out.append((start, end))
            covered = end
    return out


def rarest_pair(word: str, grams: list[tuple[int, int]], frequent: dict[str, int], rare: int, q: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """The two grams, of least frequency together, whose ends lie more than q apart."""
    weight = [frequent.get(word[a:b], rare) for a, b in grams]
    best, found, left, k = None, None, 0, 0
    for j, (_, end) in enumerate(grams):
        while grams[k][1] < end - q:  # the earlier grams that end far enough before this one
            if weight[k] < weight[left]:
                left = k
            k += 1
        if k and (best is None or weight[left] + weight[j] < best):
            best, found = weight[left] + weight[j], (grams[left], grams[j])
    return found


def spared(letters: int, q: int, left: Iterable[int], right: Iterable[int]) -> set[tuple[int, int]]:
    """(u, v): the first u and the last v letters, of words of so many, that an edit spares if it spares one of the grams.

    ``left`` has the ends b of grams behind which the edit lies: it spares the letters up to b, since a gram that ends at b is affected in b - q to b. ``right`` has
    those before which it lies: it spares the letters from b - q on. The rest is cut in halves, of which one is spared too.
    """
    out = set()
    for b in left:
        half = (letters - b - 1) // 2
        out |= {(b + 1 + half, 0), (b + 1, letters - b - 1 - half)}
    for b in right:
        half = (b - q) // 2
        out |= {(half, letters - b + q), (0, letters - half)}
    return out


def index_rows(word: str, frequent: dict[str, int], rare: int) -> Iterator[tuple[bool, int, int, int]]:
    """(probe, other, u, v) of one word: the lists that it reads (probe) and those that it is in, by their first u and last v letters.

    ``other`` is 1 where the two lengths differ: a word asks for words as long and for those a letter longer, and is listed for words as long and a letter shorter.
    """
    size = len(word)
    for other in (0, 1):
        letters = size - other  # of the word that asks
        if letters < LEAST_LETTERS:
            continue
        if letters > LONG:
            cuts = {(letters // 2, 0), (0, letters - letters // 2)}
            asked = cuts
        else:
            q = widest(letters)
            ends = decompose(word, frequent, q)
            # of the longer word, a gram ends one letter on if the edit lies before it
            cuts = spared(letters, q, (b for _, b in ends if b < letters - q), (b - other for _, b in ends if b - other > q + SHORTEST))
            if not other:
                (_, b), (_, d) = rarest_pair(word, ends, frequent, rare, q)
                asked = spared(letters, q, (b,), (d,))
        yield from ((False, other, u, v) for u, v in cuts)
        if not other:
            yield from ((True, longer, u, v) for u, v in asked for longer in (0, 1))


def one_edit(x: Column, y: Column) -> Column:
    """Whether two different strings, of which ``y`` is as long as ``x`` or a letter longer, are one edit apart; in a time that grows with their length alone.

    The length of their common beginning is found bit by bit; behind it, and a letter of ``y``, all has to be equal.
    """
    bits = F.sequence(F.lit(30), F.lit(0))
    reach = lambda at, b: at + F.pow(F.lit(2), b).cast("int")
    same = F.aggregate(bits, F.lit(0), lambda at, b: F.when((reach(at, b) <= F.length(x)) & (F.substring(x, F.lit(1), reach(at, b)) == F.substring(y, F.lit(1), reach(at, b))), reach(at, b)).otherwise(at))
    rest = lambda word, at: F.substring(word, at, F.length(word))
    replaced = (F.length(x) == F.length(y)) & (rest(x, same + 2) == rest(y, same + 2))
    return replaced | ((F.length(x) + 1 == F.length(y)) & (rest(x, same + 1) == rest(y, same + 2)))


def near_pairs(words: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """(a, b), a < b: all pairs of distinct words of :data:`LEAST_LETTERS` letters or more that are one edit apart.

    ``words`` has a column ``word`` of distinct strings; null and shorter ones are in no pair. Letters are code points. Long words are decomposed whole. An empty table
    gives an empty result.
    """
    spark = words.sparkSession
    words = words.where(F.length("word") >= LEAST_LETTERS).select("word")
    frequent, rare = gram_counts(words, most)
    held = spark.sparkContext.broadcast(frequent)  # at most ``most`` grams of each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            codes = [[probe << 61 | other << 60 | u << 30 | v for probe, other, u, v in index_rows(word, known, rare)] for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, type=pa.list_(pa.int64()))], names=["word", "codes"])

    codes = words.mapInArrow(tidy(run), "word string, codes array<long>").select("word", F.length("word").alias("size"), F.explode("codes").alias("code"))
    bits = lambda shift, n: F.shiftright("code", shift).bitwiseAND((1 << n) - 1).cast("int")
    rows = codes.select("word", "size", (bits(61, 1) == 1).alias("probe"), bits(60, 1).alias("other"), bits(30, 30).alias("u"), bits(0, 30).alias("v"))
    asks = F.when(F.col("probe"), F.col("size")).otherwise(F.col("size") - F.col("other"))
    # what shares a key by chance fails the distance like any other
    key = F.xxhash64(asks, asks + F.col("other"), "u", "v", F.substring("word", F.lit(1), F.col("u")), F.substring("word", F.col("size") - F.col("v") + 1, F.col("v")))
    rows = staged(rows.select("word", "probe", (asks > LONG).alias("long"), key.alias("key")), "grams")
    found = None
    for long, apart in ((False, F.levenshtein("x", "y", 1) == 1), (True, one_edit(F.col("x"), F.col("y")))):
        own = rows.where("long" if long else "not long")
        asked, listed = own.where("probe").select("key", F.col("word").alias("x")), own.where("not probe").select("key", F.col("word").alias("y"))
        near = asked.join(listed, "key").where((F.col("x") != F.col("y")) & apart)
        found = near if found is None else found.unionByName(near)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for ``words`` (word, n), whose words are distinct.

    A word's form is the most frequent word one edit away (ties: the smallest), if it is ``factor`` times as frequent; the root is the end of the chain of forms.
    Frequencies grow by that factor at each step, so chains are short; they are followed by doubling.
    """
    words = staged(words.select("word", "n"), "words")
    pairs = staged(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(counts, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    enough = -F.col("best.n") >= factor * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))
    formed = staged(formed, "forms")
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    steps = staged(links, "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        past, moved = steps, staged(moved, "roots")
        done = moved.where("moved").isEmpty()
        steps = moved.drop("moved")
        discard(past)
        if done:
            break
    return formed.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, of which about one in ``noise`` loses a letter, counted.

    Which one loses which letter follows from the CRC-32 of ``<id>:<run>``, so it is the same on each run. Null texts have no words, a null id is written as nothing.
    Only runs that can reach :data:`LEAST_LETTERS` letters are looked at, texts of any length whole; repeated rows count again.
    """
    # a shorter run, or one that loses a letter of seven, is no word here; the expression takes maximal runs still
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = words.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    out = hashed.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return out.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = noisy_words(documents(spark, sf_dir).select("doc_id", "text")).where("n >= 2")
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
