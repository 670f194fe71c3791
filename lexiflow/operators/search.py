"""Full-text search over n-gram postings for whole tables of queries.

An index is two tables, ``postings`` and ``grams``. A query table is rewritten, its rarest gram picks candidates, and verification by
containment makes the result exact; nothing depends on one query fitting one machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.grams import distinct_grams
from ..functions.vocabulary import INDEXED
from ..storage import discard, staged

#: Bounds of result caps and of page sizes.
MAX_RESULTS, MOST_RESULTS, PAGE = 20_000, 90_000, 16
KEY = ["ent_seq", "meta1", "meta2"]
HIT = ["query_id", "ent_seq", "kind", "lang", "meta1", "meta2", "len", "common", "score", "source_rank", "text"]


#: At most so many asked grams go to the tasks that make grams; more of them are compared by a join alone.
FEW = 50_000


def few(grams: DataFrame) -> list[str] | None:
    """The distinct grams if there are at most :data:`FEW`."""
    found = [r["gram"] for r in grams.select("gram").where("gram is not null").distinct().limit(FEW + 1).collect()]
    return found if len(found) <= FEW else None


def gram_lists(terms: DataFrame, *carried: str, only: list[str] | None = None) -> DataFrame:
    """(lang, kind, ent_seq, meta1, meta2, len, common, grams): each term with its distinct grams, or those of ``only``, and further columns that ``carried`` names."""
    return terms.select("lang", "kind", *KEY, F.length("text").alias("len"), "common", *carried, distinct_grams(F.col("text"), F.col("kind"), only).alias("grams"))


def build_postings(terms: DataFrame, *carried: str, only: list[str] | None = None) -> DataFrame:
    """(lang, gram, ent_seq, meta1, meta2, len, common): each gram of each term once.

    A term's grams are made distinct inside its row, so no shuffle is needed for that.
    """
    lists = gram_lists(terms, *carried, only=only)
    return lists.select(*[c for c in lists.columns if c != "grams"], F.explode("grams").alias("gram"))


def gram_frequencies(postings: DataFrame) -> DataFrame:
    """(lang, gram, df): postings of each gram, combined before the shuffle."""
    return postings.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("df"))


def index_totals(grams: DataFrame) -> DataFrame:
    return grams.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))


def rewrite_queries(queries: DataFrame, table: str = "reference") -> DataFrame:
    """``queries`` with q_norm, q_kana, q_long, has_long and input_type."""
    out = queries.withColumn("q_norm", X.clean_query(F.col("q_raw"))).withColumn("q_kana", X.to_hiragana(F.col("q_norm"), table))
    out = out.withColumn("q_long", X.long_vowels(F.col("q_kana")))
    return out.withColumn("has_long", F.col("q_long") != F.col("q_kana")).withColumn("input_type", X.script_bits(F.col("q_raw")))


def active_languages(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """Wanted languages that have an index."""
    return wanted.where(F.col("lang").isin(*INDEXED)).select("lang").intersect(postings.select("lang").distinct())


def query_grams(queries: DataFrame, kind: str = "gloss", text: str = "q_norm") -> DataFrame:
    """(query_id, gram): the distinct grams of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(X.grams_for(F.col(text), F.lit(kind)))).alias("gram"))


def intersect_all(postings: DataFrame, grams: DataFrame) -> DataFrame:
    """(query_id, lang, ent_seq, meta1, meta2): terms whose postings have every gram of the query. Postings of the asked grams are gathered by term."""
    asked = staged(grams.select("gram").distinct(), "grams")  # its size is known, so postings are not dealt anew if it is small
    some = postings.join(asked, "gram", "left_semi")
    return intersect_lists(staged(some.groupBy("lang", *KEY).agg(F.collect_set("gram").alias("grams")), "asked"), grams)


def intersect_lists(lists: DataFrame, grams: DataFrame) -> DataFrame:
    """The same for terms with their ``grams`` as lists, which are read twice.

    The rarest gram of a query gives its candidates, and only their lists are looked through for its other grams, so the work follows the shortest posting lists and not
    the sum of all; nothing is shuffled but frequencies.
    """
    grams = staged(grams.select("query_id", "gram").distinct(), "grams")
    asked = staged(grams.select("gram").distinct(), "wanted")
    df = lists.select(F.explode("grams").alias("gram")).join(asked, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    known = grams.join(staged(df, "frequencies"), "gram", "left")
    lead = known.groupBy("query_id").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.collect_list("gram").alias("needed"), F.count_if(F.col("df").isNull()).alias("unknown"))
    lead = staged(lead.where("unknown = 0").drop("unknown"), "lead")
    candidates = lists.select("lang", *KEY, "grams", F.explode("grams").alias("gram")).join(lead, "gram")
    return candidates.where(F.size(F.array_except("needed", "grams")) == 0).select("query_id", "lang", *KEY)


def rarest_grams(grams: DataFrame, frequencies: DataFrame, key: list[str]) -> DataFrame:
    """(key, side, gram): the gram of each query with the fewest postings; a query with an unknown gram has none."""
    known = grams.join(frequencies, ["side", "gram"], "left")
    best = known.groupBy(*key, "side").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.count_if(F.col("df").isNull()).alias("unknown"))
    return best.where("unknown = 0").drop("unknown")


def score(exact: Column, japanese: Column, length: Column, q_length: Column, common: Column) -> Column:
    """exact in bit 7, Japanese in bit 6, nearness of the lengths in bits 1 to 5, common in bit 0."""
    near = F.lit(31) - F.least(F.lit(31), F.abs(length - q_length))
    return F.shiftleft(exact.cast("int"), 7).bitwiseOR(F.shiftleft(japanese.cast("int"), 6)).bitwiseOR(F.shiftleft(near.cast("int"), 1)).bitwiseOR(common.cast("int"))


def asked_of(queries: DataFrame) -> DataFrame:
    """(query_id, source, side, q, q_norm, source_rank): a query asks Japanese forms, their long-vowel variant if it has one, and glosses
    if it has a character of another width. Sources rank in that order; for queries of fewer than three characters glosses come first."""
    short = F.length("q_norm") < 3
    one = lambda source, side, q, when, rank, first: F.when(when, F.struct(F.lit(source).alias("source"), F.lit(side).alias("side"), q.alias("q"), F.when(short, first).otherwise(rank).alias("source_rank")))
    ways = F.array(
        one("jp", "jp", F.col("q_kana"), F.lit(True), 0, 1), one("variant", "jp", F.col("q_long"), F.col("has_long"), 1, 2),
        one("gloss", "gloss", F.col("q_norm"), F.col("input_type").bitwiseAND(4) > 0, 2, 0),
    )
    return queries.select("query_id", "q_norm", F.inline(F.array_compact(ways))).where("q <> ''")


#: What a search depends on; queries that agree in it have the same hits.
ALIKE = ["q_norm", "q_kana", "q_long", "has_long", "input_type"]


def asked_once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one query of each set of queries that ask the same, (query_id, asked_id) of all): a search runs for the first and its hits go to all."""
    found = staged(queries.select("query_id", *ALIKE), "queries")
    once = staged(found.groupBy(*ALIKE).agg(F.min("query_id").alias("query_id")), "once")
    return once, staged(found.join(once.withColumnRenamed("query_id", "asked_id"), ALIKE).select("query_id", "asked_id"), "members")


def _to_all(hits: DataFrame, once: DataFrame, members: DataFrame) -> DataFrame:
    """The hits of the queries that were asked, for all that ask the same. Where these are many, hits are dealt out first, since a row becomes many."""
    if members.count() > 2 * once.count():
        hits = hits.repartition(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY, "query_id")
    return hits.withColumnRenamed("query_id", "asked_id").join(members, "asked_id").select(*HIT)


def _side() -> Column:
    return F.when(F.col("kind") == "gloss", "gloss").otherwise("jp")


def _leads(queries: DataFrame, terms: DataFrame, postings: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(the rarest gram of each question with what it asks, the postings of asked grams). Postings are read for the frequencies, by their grams alone, and read again by
    whoever takes the candidates, by the rarest grams alone: neither read needs a copy of what all questions ask for."""
    asked = asked_of(queries)
    key = ["query_id", "source"]
    # sizes are known of what is written, so the postings need not be dealt anew if the questions are small
    grams = staged(asked.select(*key, "side", F.explode(F.array_distinct(X.grams_for(F.col("q"), F.col("side")))).alias("gram")), "grams")
    wanted = staged(grams.select("side", "gram").distinct(), "wanted")
    some = (build_postings(terms, only=few(wanted)) if postings is None else postings).withColumn("side", _side()).join(wanted, ["side", "gram"], "left_semi")
    frequencies = staged(some.groupBy("side", "gram").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    return staged(asked.join(rarest_grams(grams, frequencies, key), [*key, "side"]), "lead"), some


def _scored(found: DataFrame, *carried: str) -> DataFrame:
    """A hit's score follows from lengths and commonness, which postings have, so it is known before any text is read."""
    jp = F.col("side") == "jp"
    q_length = F.when(jp, F.length("q_norm")).otherwise(F.length("q"))
    return found.where(F.col("len") >= F.length("q")).select(
        "query_id", "side", "q", "source_rank", *KEY, "lang", "kind", "len", "common", score(F.col("len") == q_length, jp, F.col("len"), q_length, F.col("common")).alias("score"), *carried
    )


def candidates_of(terms: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, side, q, source_rank, ent_seq, meta1, meta2, lang, kind, len, common, score): the terms that have the rarest gram of a query and are long enough.

    Only postings of the queries' own grams go on, through a semi-join with that small table. They are read twice, for frequencies and for candidates, and not copied.
    """
    lead, some = _leads(queries, terms, postings)
    return _scored(lead.join(some, ["side", "gram"]))


def _holds() -> Column:
    return F.contains(F.when(F.col("side") == "jp", X.fold_kana(F.col("text"))).otherwise(F.col("text")), F.col("q"))


def verified(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, ent_seq, kind, lang, meta1, meta2, len, common, score, source_rank, text): the candidates whose text holds the query."""
    found = candidates.join(terms.select(*KEY, "lang", "kind", "text"), [*KEY, "lang", "kind"])
    return found.where(_holds()).select(*HIT)


def _hits(terms: DataFrame, queries: DataFrame, postings: DataFrame | None) -> DataFrame:
    """Verified hits of distinct queries. Without stored postings the terms are read twice, for the frequencies of asked grams and for the candidates,
    and a candidate is verified in the row that its posting comes from: neither postings nor texts are dealt or written.
    """
    if postings is not None:
        return verified(candidates_of(terms, queries, postings), terms)
    lead, _ = _leads(queries, terms, None)
    some = build_postings(terms, "text", only=few(lead)).withColumn("side", _side())
    return _scored(some.join(lead, ["side", "gram"]), "text").where(_holds()).select(*HIT)


def search(terms: DataFrame, queries: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """Every verified hit, with the columns of :func:`verified`. What several queries ask is searched once."""
    once, members = asked_once(queries)
    return _to_all(_hits(terms, once, postings), once, members)


def _best(hits: DataFrame, k: int) -> DataFrame:
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))
    return best_per_entry(hits).withColumn("_k", ranked).where(F.col("_k") <= k).drop("_k")


def best_entries(terms: DataFrame, queries: DataFrame, k: int, postings: DataFrame | None = None, ahead: int = 4) -> DataFrame:
    """The best hit of each of the ``k`` best entries of each query, with the columns of :func:`verified`.

    Without stored postings hits are verified where they are found. With them, texts are read for few candidates: these are ranked by their scores, which are exact, and their
    places. The first ``ahead * k`` of each query are verified; a query that then has k entries is done, as all
    that it has not looked at come behind. The others go on with sixteen times as many, until they are done or have no more. So rounds grow with the logarithm of the
    longest list, and each task keeps no more rows of a query than are asked for before the shuffle.
    """
    once, members = asked_once(queries)
    if postings is None:
        return _to_all(_best(_hits(terms, once, None), k), once, members)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))
    found = staged(candidates_of(terms, once, postings), "candidates")
    left, whole, low, high = found, None, 0, ahead * k
    texts = terms.select(*KEY, "lang", "kind", "text")
    while True:
        # written, so that texts need not be dealt anew if it is small; for that, texts are not the side that an outer join keeps out of a broadcast
        some = staged(left.withColumn("rn", ranked).where(F.col("rn") <= high).where(F.col("rn") > low), "some")
        looked = staged(some.join(texts, [*KEY, "lang", "kind"]).where(_holds()).select(*HIT), "looked")
        whole = looked if whole is None else whole.unionByName(looked)
        entries = whole.groupBy("query_id").agg(F.count_distinct("ent_seq").alias("entries"))
        again = staged(some.where(F.col("rn") == high).select("query_id").join(entries, "query_id", "left").where(F.coalesce("entries", F.lit(0)) < k).select("query_id"), "again")
        discard(some)
        if again.isEmpty():
            break
        left, low, high = found.join(again, "query_id", "left_semi"), high, 16 * high
    return _to_all(_best(whole, k), once, members)


_ORDER = (F.desc, "score"), (F.asc, "source_rank"), (F.asc, "ent_seq"), (F.asc, "meta1"), (F.asc, "meta2")


def _order() -> list[Column]:
    return [f(c) for f, c in _ORDER]


def best_per_entry(hits: DataFrame) -> DataFrame:
    """The best hit of each entry for each query."""
    best = F.row_number().over(Window.partitionBy("query_id", "ent_seq").orderBy(*_order()))
    return hits.withColumn("k", best).where("k = 1").drop("k")


def page_size(k: Column) -> Column:
    """Sizes from 1 to 128 stand; others, and null, give the default."""
    return F.when(k.between(1, 128), k).otherwise(PAGE)


def result_limit(n: int | None) -> int:
    return n if n is not None and 1 <= n <= MOST_RESULTS else MAX_RESULTS


def cap(hits: DataFrame, max_results: int | None = None) -> DataFrame:
    """The first hits of each query by source and then place; a feature of the search, not a safeguard."""
    order = Window.partitionBy("query_id").orderBy("source_rank", "ent_seq", "meta1", "meta2")
    return hits.withColumn("k", F.row_number().over(order)).where(F.col("k") <= result_limit(max_results)).drop("k")


def pages(hits: DataFrame, k: int | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """Hits with ``page`` and ``place``, best first; the rank filter reaches below the shuffle."""
    k = page_size(F.lit(k).cast("int"))
    out = hits.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order())))
    if last is not None:
        out = out.where(F.col("rn") <= (last + 1) * k)
    return out.where(F.col("rn") > first * k).withColumn("page", F.floor((F.col("rn") - 1) / k).cast("int")).withColumn("place", F.col("rn").cast("int")).drop("rn")


def enrich(hits: DataFrame, entries: DataFrame) -> DataFrame:
    return hits.join(entries, "ent_seq", "left")
