"""Nested lexicon entries: views of an entry, flat terms, cross references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..storage import staged

DOT = "・"


def lookup(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """A row for each key; unknown keys and key 0 give nulls."""
    return keys.join(entries.where("ent_seq <> 0"), "ent_seq", "left")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name`` from 0 in the order of ``order``, which has to tell rows apart.

    Rows are dealt into as many even ranges of the order as there are shuffle partitions and written with the number of their range; ranges are
    numbered each by itself, and the table of their sizes, a row for each range, gives the starts. So no task has more than a range.
    """
    put = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = put.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = put.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    return within.join(starts, "_range").withColumn(name, (F.col("_start") + F.col("_k") - 1).cast("long")).drop("_range", "_k", "_start")


def with_ordinal(entries: DataFrame) -> DataFrame:
    """``entry_idx`` from 0 in the order of ent_seq."""
    return numbered(entries, ["ent_seq"], "entry_idx")


def headword() -> Column:
    """First written form, else first reading, else ``[unknown]``."""
    return F.coalesce(F.get("k_ele", F.lit(0))["keb"], F.get("r_ele", F.lit(0))["reb"], F.lit("[unknown]"))


def variants() -> Column:
    """The further written forms, with middle dots between."""
    return F.array_join(F.when(F.size("k_ele") > 1, F.slice(F.col("k_ele.keb"), 2, F.size("k_ele"))).otherwise(F.array().cast("array<string>")), DOT)


def readings() -> Column:
    return F.array_join(F.col("r_ele.reb"), DOT)


def gloss_in(active: list[str]) -> Column:
    """Glosses of the first sense in an active language that has any."""
    found = F.get(F.filter("senses", lambda s: s["lang"].isin(*active) & (F.size(s["gloss"]) > 0)), F.lit(0))
    return F.coalesce(F.array_join(found["gloss"], "; "), F.lit(""))


def first_meaning() -> Column:
    return F.coalesce(F.array_join(F.get("senses", F.lit(0))["gloss"], "; "), F.lit(""))


#: The label lists that a sense may have beside its glosses and references.
SENSE_LISTS = ("pos", "stagk", "stagr", "field", "misc", "s_inf", "dial")


def full_view(entries: DataFrame, active: list[str]) -> DataFrame:
    """(ent_seq, headword, kanji, readings, senses): everything that an entry page shows.

    ``kanji`` and ``readings`` are the forms with all their marks. ``senses`` are those in active languages, each with its place, glosses with their types,
    all label lists, loan sources, and its references and antonyms as (id, label) of the entries that they resolve to, in their order;
    unresolved ones are left out. References are resolved by joins for all entries together; an entry has few, so they come back as one list.
    """
    heads = entries.select(F.col("ent_seq").alias("target_seq"), headword().alias("label"))
    linked = resolve_references(unresolved_references(entries), entries).where("target_seq is not null").join(heads, "target_seq")
    links = linked.groupBy("ent_seq").agg(F.array_sort(F.collect_list(F.struct("sense_i", "kind", "i", F.col("target_seq").alias("id"), "label"))).alias("links"))
    of = lambda kind, at: F.transform(F.filter("links", lambda x: (x["kind"] == kind) & (x["sense_i"] == at)), lambda x: F.struct(x["id"], x["label"]))
    told = F.transform(
        "senses",
        lambda s, i: F.struct(
            i.alias("i"), s["lang"].alias("lang"), s["gloss"].alias("gloss"), s["g_type"].alias("g_type"), *[s[c].alias(c) for c in SENSE_LISTS],
            s["lsource"].alias("lsource"), of("xref", i).alias("xref"), of("ant", i).alias("ant"),
        ),
    )
    rows = entries.join(links, "ent_seq", "left").withColumn("links", F.coalesce("links", F.array().cast(links.schema["links"].dataType)))
    return rows.select("ent_seq", headword().alias("headword"), F.col("k_ele").alias("kanji"), F.col("r_ele").alias("readings"), F.filter(told, lambda s: s["lang"].isin(*active)).alias("senses"))


def restriction_places(names: Column, forms: Column) -> Column:
    """Places (from 0) of the named forms; null for a name that the entry lacks."""
    return F.transform(names, lambda n: F.when(F.array_position(forms, n) > 0, F.array_position(forms, n) - 1))


def restricted_forms(places: Column, forms: Column) -> Column:
    """The inverse of :func:`restriction_places`; unknown places are left out."""
    return F.array_compact(F.transform(places, lambda i: F.get(forms, i.cast("int"))))


def reading_applies(re_restr: Column, keb: Column) -> Column:
    """A reading without restrictions goes with every written form."""
    return (F.size(re_restr) <= 0) | F.array_contains(re_restr, keb)


def card_face(deck: Column, word: Column, meaning: Column) -> Column:
    """(question, answer): recall swaps the sides."""
    recall = deck == "recall"
    return F.struct(F.when(recall, meaning).otherwise(word).alias("question"), F.when(recall, word).otherwise(meaning).alias("answer"))


def terms(entries: DataFrame) -> DataFrame:
    """(ent_seq, text, meta1, meta2, kind, lang, common): written forms, first folded readings, glosses by language.

    One pass over the entries explodes all three; written forms are folded as well, since queries are.
    """
    common = F.greatest(V.is_common(F.flatten(F.col("k_ele.ke_pri"))), V.is_common(F.flatten(F.col("r_ele.re_pri"))), F.lit(0))
    row = lambda text, m1, m2, kind, lang: F.struct(text.alias("text"), m1.cast("int").alias("meta1"), m2.cast("int").alias("meta2"), F.lit(kind).alias("kind"), lang.alias("lang"))
    kanji = F.transform("k_ele", lambda k, i: row(X.fold_kana(k["keb"]), i, F.lit(0), "kanji", F.lit("jp")))
    reading = F.transform(X.first_readings(F.col("r_ele.reb")), lambda r: row(r["text"], r["i"], F.lit(0), "reading", F.lit("jp")))
    gloss = F.flatten(F.transform("senses", lambda s, i: F.transform(s["gloss"], lambda g, j: row(g, i, j, "gloss", s["lang"]))))
    return entries.select("ent_seq", common.alias("common"), F.inline(F.concat(kanji, reading, gloss)))


def unresolved_references(entries: DataFrame) -> DataFrame:
    """(ent_seq, sense_i, kind, i, target): every xref and ant string of every sense."""
    of = lambda s, i, kind: F.transform(s[kind], lambda t, j: F.struct(i.alias("sense_i"), F.lit(kind).alias("kind"), j.alias("i"), t.alias("target")))
    return entries.select("ent_seq", F.inline(F.flatten(F.transform("senses", lambda s, i: F.concat(of(s, i, "xref"), of(s, i, "ant"))))))


def resolve_references(references: DataFrame, entries: DataFrame) -> DataFrame:
    """``references`` with ``target_seq``: the first entry with the primary part as written form or reading, or the secondary as reading.

    Forms are joined by text, once for both parts: a reference asks for one or two (text, kind) pairs, and the least entry
    of all answers is kept.
    """
    forms = entries.select("ent_seq", F.explode(F.concat(F.transform(F.col("k_ele.keb"), lambda t: F.struct(t.alias("text"), F.lit("k").alias("kind"))), F.transform(F.col("r_ele.reb"), lambda t: F.struct(t.alias("text"), F.lit("r").alias("kind"))))).alias("f"))
    first = forms.groupBy(F.col("f.text").alias("text")).agg(F.min("ent_seq").alias("any_seq"), F.min(F.when(F.col("f.kind") == "r", F.col("ent_seq"))).alias("reading_seq"))
    key = ["ent_seq", "sense_i", "kind", "i"]
    parts = X.split_reference(F.col("target"))
    asked = references.select(*key, "target", F.inline(F.array(F.struct(parts["primary"].alias("text"), F.lit(1).alias("part")), F.struct(parts["secondary"].alias("text"), F.lit(2).alias("part")))))
    answered = asked.join(first, "text", "left").groupBy(*key, "target").agg(F.min(F.when(F.col("part") == 1, F.col("any_seq")).otherwise(F.col("reading_seq"))).alias("target_seq"))
    return answered


def reference_headwords(resolved: DataFrame, entries: DataFrame) -> DataFrame:
    """(ent_seq, kind, words): headwords of the resolved references in their order; unresolved ones drop out."""
    heads = entries.select(F.col("ent_seq").alias("target_seq"), headword().alias("word"))
    found = resolved.where("target_seq is not null").join(heads, "target_seq")
    listed = F.array_sort(F.collect_list(F.struct("sense_i", "i", "word")))
    return found.groupBy("ent_seq", "kind").agg(F.transform(listed, lambda x: x["word"]).alias("words"))
