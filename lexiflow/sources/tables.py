"""Schemas, readers and writers of the tables: terms, entries, postings, events, snapshots, decks, history."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import posting_blocks, unpack
from ..operators.lexicon import numbered
from ..operators.search import build_postings
from ..storage import freed, staged

#: Version that writers put beside their rows and readers ask for.
SCHEMA_VERSION = 1
TERMS = "ent_seq long, text string, meta1 int, meta2 int, n_bytes int, common int"
EVENTS = (
    "learner_id long, deck string, card_id long, device_id decimal(20,0), seq long, ts long, type string, rating int, state int, step int, "
    "stability double, difficulty double, reps int, lapses int, flags int, due_ts long, last_review long"
)
#: Events in one file of the history sink.
CHUNK = 1000


def versioned(df: DataFrame) -> DataFrame:
    return df.withColumn("schema_version", F.lit(SCHEMA_VERSION))


def read_versioned(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table written by this module; another version stops the read when its rows are seen, without a pass of its own."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if "schema_version" not in df.columns:
        raise ValueError(f"{path} has no schema_version")
    ok = F.when(F.col("schema_version") == SCHEMA_VERSION, True).otherwise(F.raise_error(F.concat(F.lit(f"{path} has schema version "), F.col("schema_version").cast("string"))).cast("boolean"))
    return df.where(ok).drop("schema_version")


def write_entries(entries: DataFrame, path: str) -> None:
    """Sorted by key in ranges, so that a lookup reads few row groups."""
    versioned(entries).repartitionByRange("ent_seq").sortWithinPartitions("ent_seq").write.mode("overwrite").parquet(path)


#: Files that a task holds open at once; languages, and the buckets that a task writes, are fewer.
OPEN_FILES = 64


@contextmanager
def _open_files(spark: SparkSession) -> Iterator[None]:
    """Tasks that write folders hold a file open for each and write rows as they come, instead of sorting them by folder first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, OPEN_FILES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_terms(terms: DataFrame, path: str, tsv: bool = False) -> None:
    """One folder for each language; Parquet, or tab-separated with the bytes of the text as the fifth column.

    A task holds a file open for each language and writes rows as they come, so it sorts nothing and its memory does not grow with its rows.
    """
    out = terms.select("lang", "ent_seq", "text", "meta1", "meta2", F.octet_length("text").alias("n_bytes"), "common")
    with _open_files(terms.sparkSession):
        if tsv:
            out.write.partitionBy("lang").mode("overwrite").option("sep", "\t").csv(path)
        else:
            versioned(out).write.partitionBy("lang").mode("overwrite").parquet(path)


def read_terms_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Terms from tab-separated files: comments, blank lines, rows without a number first or without text are skipped; missing numbers are 0."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").option("mode", "PERMISSIVE").schema(TERMS).csv(path)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return raw.where("ent_seq is not null and text is not null").select("ent_seq", "text", zero("meta1"), zero("meta2"), F.octet_length("text").alias("n_bytes"), zero("common"))


def parse_term_lines(lines: DataFrame) -> DataFrame:
    """The same rules for a table of lines (column ``value``)."""
    part = F.split("value", "\t")
    number = lambda i: F.coalesce(F.get(part, F.lit(i)).try_cast("int"), F.lit(0))
    seq = F.get(part, F.lit(0)).try_cast("long")
    kept = lines.where(~F.startswith("value", F.lit("#")) & (F.size(part) >= 2) & seq.isNotNull() & (F.get(part, F.lit(1)) != ""))
    return kept.select(seq.alias("ent_seq"), F.get(part, F.lit(1)).alias("text"), number(2).alias("meta1"), number(3).alias("meta2"), number(5).alias("common"))


#: Postings of a bucket, about.
BUCKET = 1_000_000
#: Buckets of an index, about, at most: each is a folder that the driver lists. An index of more rows has larger ones.
MOST_BUCKETS = 4096


#: Postings that are dealt to their buckets at once, about, and shares of them at most: each adds a file to a bucket and reads the terms again. An index of more postings has larger ones.
SHARE, MOST_SHARES = 32_000_000, 16


def _share(df: DataFrame, k: int, n: int) -> DataFrame:
    """The rows of the share ``k`` of the entries, of ``n``."""
    return df if n == 1 else df.where(F.pmod(F.xxhash64("ent_seq", F.lit("share")), F.lit(n)) == k)


def write_index(terms: DataFrame, path: str, rows: int = BUCKET) -> None:
    """:func:`write_postings` of all grams of ``terms``. Each share makes the grams of its own terms, so none is made again for another, and they are dealt as blocks, not rows."""
    postings = build_postings(terms)
    counted = terms.withColumn("len", F.length("text"))
    numbers = [c for c in postings.columns if c not in ("lang", "kind", "gram")]

    def blocks(k: int, n: int, hot: DataFrame) -> DataFrame:
        # a gram is in it only if it has more than a quarter of a bucket, so there are at most four for each bucket
        return posting_blocks(_share(counted, k, n), numbers, {(r["lang"], r["gram"]): r["parts"] for r in hot.collect()})

    counts = posting_blocks(terms, [], {}).groupBy("lang", "gram").agg(F.sum("_n").alias("n"))
    write_postings(postings, path, rows, counts, blocks)


def write_postings(postings: DataFrame, path: str, rows: int = BUCKET, counts: DataFrame | None = None, blocks: Callable[[int, int, DataFrame], DataFrame] | None = None) -> None:
    """Partitioned by language and bucket, sorted by gram: a query's grams prune to few files, and no file or task has much more than ``rows`` postings.

    A first pass counts: a language gets a bucket for each ``rows`` postings, and a gram with more than a quarter of that is split into parts by entry, dealt over
    several buckets. Both are written beside the postings, so readers need no parameter. ``rows`` grows once there would be more than :data:`MOST_BUCKETS`.
    Then the postings are dealt to their buckets a share of the entries at a time, of about :data:`SHARE` postings or a :data:`MOST_SHARES`-th of all, and what a share shuffles is deleted before the next: on disk are
    the index and one share. ``counts`` (lang, gram, n) is what the first pass gives, if there is a shorter way to it; ``blocks`` gives the postings of a share as ``posting_blocks`` does, which is less to make and to shuffle than choosing rows from all. A task sorts a few buckets, whatever the size of the index.
    """
    spark = postings.sparkSession
    grams = staged(postings.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")) if counts is None else counts, "frequencies")
    total = grams.agg(F.sum("n")).first()[0] or 0
    rows, shares = max(rows, -(-total // MOST_BUCKETS)), min(MOST_SHARES, max(1, -(-total // SHARE)))
    counted = staged(grams.groupBy("lang").agg(F.ceil(F.sum("n") / rows).cast("int").alias("buckets"), F.collect_list(F.when(F.col("n") > rows / 4, F.struct("gram", F.ceil(4 * F.col("n") / rows).cast("int").alias("parts")))).alias("hot")), "counted")
    layout, hot = counted.select("lang", "buckets"), staged(counted.select("lang", F.inline("hot")), "hot")
    versioned(layout).write.mode("overwrite").parquet(f"{path}/layout")
    versioned(hot).write.mode("overwrite").parquet(f"{path}/split")
    part = F.pmod(F.xxhash64("ent_seq"), F.coalesce("parts", F.lit(1))).cast("int")
    tasks = max(1, -(-(layout.agg(F.sum("buckets")).first()[0] or 0) // shares))
    shape = postings.limit(0).withColumn("bucket", F.lit(0))
    versioned(shape).write.mode("overwrite").parquet(f"{path}/shape")
    for k in range(shares):
        some = blocks(k, shares, hot) if blocks else _share(postings, k, shares).join(hot, ["lang", "gram"], "left").withColumn("part", part)
        placed = some.join(layout, "lang").withColumn("bucket", _bucket(F.col("part"))).drop("part", "parts", "buckets")
        # no sort by folder, which would compare the same few languages and buckets over and over; rows of a gram keep the order of their entries within a task that made them
        dealt = placed.repartition(tasks, "lang", "bucket").sortWithinPartitions("gram")
        dealt = versioned(unpack(dealt, shape.schema) if blocks else dealt.select(shape.columns))
        with freed(spark), _open_files(spark):
            dealt.write.partitionBy("lang", "bucket").option("maxRecordsPerFile", rows).option("compression", "zstd").mode("append" if k else "overwrite").parquet(f"{path}/postings")


def _bucket(part: Column) -> Column:
    return F.pmod(F.xxhash64("gram", part), "buckets").cast("int")


def read_postings(spark: SparkSession, path: str, grams: DataFrame | None = None) -> DataFrame:
    """The postings; with ``grams`` only the folders that hold these are read: at most as many numbers as there are folders reach the driver."""
    found = _shaped(spark, path, "postings")
    if grams is not None:
        layout = read_versioned(spark, f"{path}/layout").collect()  # a row for each language
        langs = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["buckets"]).alias("buckets")) for r in layout]) if layout else F.array().cast("array<struct<lang:string,buckets:int>>")
        asked = grams.select("gram").distinct().select("gram", F.inline(langs)).join(read_versioned(spark, f"{path}/split"), ["lang", "gram"], "left")
        parts = asked.select("lang", "gram", "buckets", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        wanted: dict[str, list[int]] = {}
        for r in parts.select("lang", _bucket(F.col("part")).alias("bucket")).distinct().toLocalIterator():
            wanted.setdefault(r["lang"], []).append(r["bucket"])
        here = F.lit(False)
        for lang, buckets in sorted(wanted.items()):
            here = here | ((F.col("lang") == lang) & F.col("bucket").isin(buckets))
        found = found.where(here)
    return found.drop("bucket")


#: Rows of a block of a table for lookups, about.
BLOCK = 100_000


def write_lookup(entries: DataFrame, path: str, rows: int = BLOCK) -> None:
    """A table for lookups by ``ent_seq``: blocks of equal width in the key, each a folder with its rows sorted, and the widths beside them.

    Keys are unique, so a block has no more rows than it is wide, however unevenly they lie.
    """
    seen = entries.agg(F.min("ent_seq").alias("low"), F.max("ent_seq").alias("high"), F.count(F.lit(1)).alias("n"))
    layout = seen.select(F.coalesce("low", F.lit(0)).cast("long").alias("low"), F.coalesce(F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / rows)), F.lit(1)).cast("long").alias("width"))
    versioned(layout).write.mode("overwrite").parquet(f"{path}/layout")
    low, width = _widths(entries.sparkSession, path)
    placed = versioned(entries).withColumn("block", F.floor((F.col("ent_seq") - low) / width).cast("long"))
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/shape")
    placed.repartition("block").sortWithinPartitions("block", "ent_seq").write.partitionBy("block").mode("overwrite").parquet(f"{path}/rows")


def _shaped(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table in folders by the schema that stands beside it, so that one without rows can be read as well."""
    return read_versioned(spark, f"{path}/{name}", spark.read.parquet(f"{path}/shape").schema)


def _widths(spark: SparkSession, path: str) -> tuple[int, int]:
    r = read_versioned(spark, f"{path}/layout").first()
    return r["low"], r["width"]


def read_lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The stored rows of the blocks that ``keys`` (ent_seq) lie in, for a join with them: at most as many numbers as there are blocks reach the driver."""
    low, width = _widths(spark, path)
    blocks = [r["b"] for r in keys.where("ent_seq is not null").select(F.floor((F.col("ent_seq") - low) / width).cast("long").alias("b")).distinct().toLocalIterator()]
    return _shaped(spark, path, "rows").where(F.col("block").isin(blocks)).drop("block")


def append_events(events: DataFrame, path: str) -> None:
    versioned(events).write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_versioned(spark, path)


#: Kinds of events.
TYPES = ("add", "review", "remove", "suspend", "update", "undo")


def lacking(events: DataFrame) -> Column:
    """What a torn record lacks first: a device, a sequence number, a time, a card or a known type; null for a sound one."""
    needed = (("device", "device_id"), ("seq", "seq"), ("time", "ts"), ("card", "card_id"))
    known = F.coalesce(events["type"].isin(*TYPES), F.lit(False))
    return F.coalesce(*[F.when(events[c].isNull(), F.lit(name)) for name, c in needed], F.when(~known, F.lit("type")))


def sound_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events that can be used, quarantine)."""
    return events.where(lacking(events).isNull()), events.where(lacking(events).isNotNull())


def save_snapshot(cards: DataFrame, path: str, version: int) -> str:
    """A new folder for each version; older ones stay readable while it is written."""
    at = f"{path}/version={version}"
    versioned(cards).write.mode("overwrite").parquet(at)
    return at


def save_deck(cards: DataFrame, counters: DataFrame, path: str) -> None:
    versioned(cards).write.partitionBy("deck").mode("overwrite").parquet(f"{path}/cards")
    versioned(counters).write.partitionBy("deck").mode("overwrite").parquet(f"{path}/day_counters")


def load_deck(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_versioned(spark, f"{path}/cards"), read_versioned(spark, f"{path}/day_counters")


def counters_of_day(counters: DataFrame, day: int) -> DataFrame:
    """Saved counters count on their own day only."""
    return counters.where(F.col("day") == day)


def append_history(history: DataFrame, path: str) -> None:
    """An audit log in files of at most :data:`CHUNK` events; ``history.append_chunks`` also goes on in the newest chunk."""
    versioned(history).write.option("maxRecordsPerFile", CHUNK).mode("append").parquet(path)


def history_chunks(events: DataFrame) -> DataFrame:
    """(learner_id, chunk, n, first_ts, last_ts): each learner's log in chunks of :data:`CHUNK` events by time.

    Events are numbered over the whole log in even ranges, and a learner's first number is subtracted, so a learner with many events is dealt over many tasks.
    """
    order = ["learner_id", "ts", "device_id", "seq"]
    put = numbered(events.select(*order), order, "k")
    first = put.groupBy("learner_id").agg(F.min("k").alias("first"))
    rows = put.join(first, "learner_id").withColumn("chunk", F.floor((F.col("k") - F.col("first")) / CHUNK).cast("int"))
    return rows.groupBy("learner_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def history_events(events: DataFrame) -> DataFrame:
    """Audit rows: kind, and the rating before and after each event of a card; an undo is told apart from an answer."""
    w = Window.partitionBy("learner_id", "deck", "card_id").orderBy("ts", "device_id", "seq")
    kind = F.when(F.col("type") == "review", F.when(F.row_number().over(w) == 1, "add").otherwise("answer")).otherwise(F.col("type"))
    return events.select("learner_id", "deck", "card_id", "device_id", "seq", "ts", kind.alias("kind"), F.lag("rating").over(w).alias("before_rating"), F.col("rating").alias("after_rating"))


def read_custom_decks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(deck_id, name, ent_seq) from JSON arrays of decks, one in a file or, with ``lines``, one in a line; decks without id are dropped."""
    raw = spark.read.schema("id string, name string, entSeqs array<long>").option("multiLine", not lines).json(path)
    return raw.where("id <> ''").select(F.col("id").alias("deck_id"), "name", F.explode_outer("entSeqs").alias("ent_seq"))


#: Entries in one object of a written custom deck, about.
DECK_PART = 100_000


def custom_decks_json(decks: DataFrame) -> DataFrame:
    """(id, name, entSeqs): one row for each deck, its entries sorted; a deck of many entries has several rows of about :data:`DECK_PART`."""
    parts = decks.groupBy("deck_id", "name").agg(F.ceil(F.count(F.lit(1)) / DECK_PART).alias("parts"))
    rows = decks.join(parts, ["deck_id", "name"]).withColumn("part", F.pmod(F.xxhash64("ent_seq"), "parts"))
    return rows.groupBy(F.col("deck_id").alias("id"), "name", "part").agg(F.array_sort(F.collect_set("ent_seq")).alias("entSeqs")).drop("part")


def write_custom_decks(decks: DataFrame, path: str) -> None:
    """Each line of the files is a JSON array with one object of :func:`custom_decks_json`, which :func:`read_custom_decks` reads back."""
    custom_decks_json(decks).select(F.to_json(F.array(F.struct("id", "name", "entSeqs")))).write.mode("overwrite").text(path)


def edit_custom_decks(decks: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Decks with rows added, and decks (deck_id) or single entries (deck_id, ent_seq) removed."""
    keys = [c for c in ("deck_id", "ent_seq") if c in removed.columns]
    return decks.unionByName(added).dropDuplicates(["deck_id", "ent_seq"]).join(removed.select(*keys).distinct(), keys, "left_anti")
