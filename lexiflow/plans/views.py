"""Lexicon and review tables derived from the driver's tables, in Spark and as DuckDB SQL.

Each view is one narrow pass over its table, so work over a view grows with the table and its filters and columns reach the
scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lex_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-empty line of the documents as a gloss of entry doc_id; common is the document's quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("meta1", "text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    lines = docs.where("text <> ''").join(labels, "doc_id", "left")
    return lines.select(
        F.col("doc_id").alias("ent_seq"), "text", "meta1", F.lit(0).alias("meta2"), F.lit("gloss").alias("kind"), "lang",
        F.coalesce("quality", F.lit(0)).cast("int").alias("common"),
    )


LEX_TERMS = """lex_terms AS (
  SELECT d.doc_id AS ent_seq, d.text, d.meta1, 0 AS meta2, 'gloss' AS kind, d.lang, coalesce(l.quality, 0)::INTEGER AS common
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS meta1 FROM documents) d
  LEFT JOIN labels l USING (doc_id) WHERE d.text <> '')"""


def lex_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run of three or more letters of each benchmark text, as a query."""
    word = F.regexp_extract("text", "[A-Za-z]{3,}", 0)
    return table(spark, sf_dir, "benchmark").where(word != "").select(F.col("item_id").alias("query_id"), F.lower(word).alias("q_raw"))


LEX_QUERIES = """lex_queries AS (
  SELECT item_id AS query_id, lower(regexp_extract(text, '[A-Za-z]{3,}', 0)) AS q_raw FROM benchmark WHERE regexp_extract(text, '[A-Za-z]{3,}', 0) <> '')"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as nested lexicon entries: name and brand are written forms, the words of the name readings, type and
    container senses in English, Spanish and German."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    form = lambda keb, pri: F.struct(keb.alias("keb"), F.array().cast("array<string>").alias("ke_inf"), pri.alias("ke_pri"))
    mark = F.array(F.when(F.col("p_size") <= 10, "news1").when(F.col("p_size") <= 20, "nf12").otherwise("oth1"))
    sense = lambda lang, *gloss: F.struct(F.lit(lang).alias("lang"), F.array_compact(F.array(*gloss)).alias("gloss"))
    return p.select(
        F.col("p_partkey").alias("ent_seq"),
        F.when(F.col("p_size") % 5 == 0, F.array().cast("array<struct<keb:string,ke_inf:array<string>,ke_pri:array<string>>>"))
        .otherwise(F.array(form(F.col("p_name"), mark), form(F.col("p_brand"), F.array().cast("array<string>")))).alias("k_ele"),
        F.transform(F.concat(words, words), lambda w: F.struct(w.alias("reb"), F.array().cast("array<string>").alias("re_pri"))).alias("r_ele"),
        F.array(
            sense("de", F.when(F.col("p_size") % 3 == 0, F.col("p_type"))),
            sense("en", F.col("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string"))),
            sense("es", F.col("p_brand")),
        ).alias("senses"),
    )


ENTRIES = """entries AS (
  SELECT p_partkey AS ent_seq, p_name, p_brand, p_type, p_size,
    CASE WHEN p_size % 5 = 0 THEN [] ELSE [p_name, p_brand] END AS kebs,
    CASE WHEN p_size % 5 = 0 THEN [] ELSE [CASE WHEN p_size <= 10 THEN 'news1' WHEN p_size <= 20 THEN 'nf12' ELSE 'oth1' END] END AS pris,
    list_concat(string_split(p_name, ' '), string_split(p_name, ' ')) AS rebs,
    CASE WHEN p_size % 3 = 0 THEN [p_type] ELSE [] END AS de, [p_type, 'size ' || p_size] AS en, [p_brand] AS es FROM part)"""


#: Entities of the lexicon that :func:`write_lexicon` writes.
ENTITIES = {
    "n": "noun (common) (futsuumeishi)", "vs": "noun or participle which takes the aux. verb suru", "ateji": "ateji (phonetic) reading", "ik": "word containing irregular kana usage",
    "comp": "computing", "uk": "word usually written using kana alone", "ksb": "Kansai-ben",
}
GLOSS_TYPES = ("lit", "fig", "expl", "tm", "descr")


def write_lexicon(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The parts as a lexicon in XML, with every element that an entry can have and entities for its labels, a file for each task and one for the document type."""
    n, has_k = F.col("p_size"), F.col("p_size") % 5 != 0
    words = F.split("p_name", " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    tag = lambda t, *c: F.concat(F.lit(f"<{t}>"), *c, F.lit(f"</{t}>"))
    entity = lambda t, e: F.lit(f"<{t}>&{e};</{t}>")
    some = lambda when, c: F.when(when, c).otherwise("")
    mark = F.when(n <= 10, "news1").when(n <= 20, "nf12").otherwise("oth1")
    kanji = some(has_k, F.concat(tag("k_ele", tag("keb", F.col("p_name")), some(n % 4 == 0, entity("ke_inf", "ateji")), tag("ke_pri", mark)), tag("k_ele", tag("keb", F.col("p_brand")))))
    reading = tag(
        "r_ele", tag("reb", first), some(~has_k, F.lit("<re_nokanji/>")), some(has_k & (n % 2 == 1), tag("re_restr", F.col("p_name"))), some(n % 7 == 0, entity("re_inf", "ik")),
        some(n % 3 == 0, tag("re_pri", F.lit("ichi1"))),
    )
    g_type = F.concat(*[some(n % 6 == k + 1, F.lit(f' g_type="{t}"')) for k, t in enumerate(GLOSS_TYPES)])
    sense = tag(
        "sense", some(has_k & (n % 3 == 0), tag("stagk", F.col("p_brand"))), some(n % 4 == 1, tag("stagr", first)), entity("pos", "n"), some(n % 2 == 0, entity("pos", "vs")),
        tag("xref", last, F.lit("・"), F.col("p_brand")), tag("ant", F.col("p_brand")), some(n % 6 == 0, entity("field", "comp")), some(n % 5 == 1, entity("misc", "uk")),
        tag("s_inf", F.lit("size "), n.cast("string"), F.lit(" &amp; more")), F.lit('<lsource xml:lang="fre"'), some(n % 2 == 1, F.lit(' ls_type="part"')), some(n % 3 == 0, F.lit(' ls_wasei="y"')),
        F.lit(">"), F.col("p_brand"), F.lit("</lsource>"), some(n % 8 == 0, entity("dial", "ksb")), F.lit("<gloss"), g_type, F.lit(">"), F.col("p_type"), F.lit("</gloss>"), tag("gloss", F.lit("size "), n.cast("string")),
    )
    spanish = F.concat(F.lit('<sense><gloss xml:lang="spa">'), F.col("p_brand"), F.lit("</gloss></sense>"))
    other = some(n % 9 == 0, F.concat(F.lit('<sense><gloss xml:lang="xyz">'), F.col("p_name"), F.lit("</gloss></sense>")))
    entry = tag("entry", tag("ent_seq", F.col("p_partkey").cast("string")), kanji, reading, tag("r_ele", tag("reb", last)), sense, spanish, other)
    head = [f'<!ENTITY {name} "{text}">' for name, text in ENTITIES.items()]
    spark.range(1).select(F.explode(F.array(*map(F.lit, head))).alias("value")).write.text(path)
    table(spark, sf_dir, "part").select(entry.alias("value")).write.mode("append").text(path)


def _if(when: str, then: str) -> str:
    return f"CASE WHEN {when} THEN {then} ELSE '' END"


#: The same entries from the parts: forms with their marks, and the lists of the first sense.
LEXICON = f"""lx AS (
  SELECT p_partkey AS ent_seq, p_name, p_brand, p_type, p_size AS n, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last, p_size % 5 <> 0 AS has_k FROM part),
lexicon AS (SELECT ent_seq, n, p_name, p_brand, p_type, first, last, has_k, CASE WHEN has_k THEN p_name ELSE first END AS head,
  {_if("has_k", f"p_name || '(' || {_if('n % 4 = 0', repr(ENTITIES['ateji']))} || ')(' || CASE WHEN n <= 10 THEN 'news1' WHEN n <= 20 THEN 'nf12' ELSE 'oth1' END || ')|' || p_brand || '()()'")} AS kanji,
  first || '(' || CASE WHEN has_k THEN 'false' ELSE 'true' END || ')(' || {_if('has_k AND n % 2 = 1', 'p_name')} || ')(' || {_if('n % 7 = 0', repr(ENTITIES['ik']))} || ')(' || {_if('n % 3 = 0', "'ichi1'")} || ')|' || last || '(false)()()()' AS readings,
  '{ENTITIES['n']}' || {_if('n % 2 = 0', repr(';' + ENTITIES['vs']))} || ':' || {_if('has_k AND n % 3 = 0', 'p_brand')} || ':' || {_if('n % 4 = 1', 'first')} || ':' || {_if('n % 6 = 0', repr(ENTITIES['comp']))} || ':' ||
    {_if('n % 5 = 1', repr(ENTITIES['uk']))} || ':size ' || n || ' & more:' || {_if('n % 8 = 0', repr(ENTITIES['ksb']))} AS lists,
  p_brand || ',' || CASE WHEN n % 2 = 1 THEN 'true' ELSE 'false' END || ',' || CASE WHEN n % 3 = 0 THEN 'true' ELSE 'false' END AS lsource,
  p_type || ';size ' || n AS glosses, [{', '.join(map(repr, ('none', *GLOSS_TYPES)))}][n % 6 + 1] AS g_type FROM lx)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reference strings for each entry: a word of its name, and name and brand with a dot between."""
    p = table(spark, sf_dir, "part")
    word = F.element_at(F.split("p_name", " "), -1)
    targets = F.array(F.struct(F.lit("xref").alias("kind"), F.concat_ws("・", word, "p_brand").alias("target")), F.struct(F.lit("ant").alias("kind"), F.concat_ws("・", "p_brand", word).alias("target")))
    return p.select(F.col("p_partkey").alias("ent_seq"), F.lit(0).alias("sense_i"), F.inline(targets)).withColumn("i", F.lit(0))


REFERENCES = """refs AS (
  SELECT p_partkey AS ent_seq, 0 AS sense_i, kind, 0 AS i, CASE WHEN kind = 'xref' THEN string_split(p_name, ' ')[-1] || '・' || p_brand ELSE p_brand || '・' || string_split(p_name, ' ')[-1] END AS target
  FROM part CROSS JOIN (VALUES ('xref'), ('ant')) k(kind))"""


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a review log: ten learners, two decks, three devices; signups undo."""
    e = table(spark, sf_dir, "events")
    rating = F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "error", 1)
    return e.select(
        F.pmod("user_id", F.lit(10)).cast("long").alias("learner_id"),
        F.when(F.col("event_id") % 2 == 0, "recog").otherwise("recall").alias("deck"),
        F.col("user_id").cast("long").alias("card_id"),
        (F.col("event_id") % 3).cast("decimal(20,0)").alias("device_id"),
        F.col("event_id").cast("long").alias("seq"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"),
        F.when(F.col("event_type") == "signup", "undo").otherwise("review").alias("type"),
        rating.cast("int").alias("rating"),
    )


REVIEW_EVENTS = """review_events AS (
  SELECT (user_id % 10)::BIGINT AS learner_id, CASE WHEN event_id % 2 = 0 THEN 'recog' ELSE 'recall' END AS deck, user_id::BIGINT AS card_id,
    (event_id % 3)::DECIMAL(20,0) AS device_id, event_id::BIGINT AS seq, floor(epoch(ts))::BIGINT AS ts,
    CASE WHEN event_type = 'signup' THEN 'undo' ELSE 'review' END AS type,
    CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 1 END AS rating FROM events)"""


def hot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review log with a third of all events on one card."""
    hot = F.col("seq") % 3 == 0
    on = lambda c, v: F.when(hot, F.lit(v)).otherwise(F.col(c)).alias(c)
    return review_events(spark, sf_dir).select(on("learner_id", 0).cast("long").alias("learner_id"), on("deck", "recog"), on("card_id", 0).cast("long").alias("card_id"), "device_id", "seq", "ts", "type", "rating")


#: The same, in place of the review log.
HOT_EVENTS = REVIEW_EVENTS.replace("review_events AS", "all_events AS") + """,
review_events AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN 0 ELSE learner_id END AS learner_id, CASE WHEN seq % 3 = 0 THEN 'recog' ELSE deck END AS deck, CASE WHEN seq % 3 = 0 THEN 0 ELSE card_id END AS card_id) FROM all_events)"""


def sql(*views: str, recursive: bool = False) -> str:
    """``WITH`` and the views, to be followed by more common tables or the query."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(views)


#: The moment at which plans and statistics are taken: within the time of the events.
NOW = 1_705_600_000


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card table that follows from the review log by counts and sums: one row for each learner, deck and card."""
    e = review_events(spark, sf_dir)
    g = e.groupBy("learner_id", "deck", "card_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("rating", F.lit(0))).alias("r"), F.count_if(F.col("rating") == 1).alias("again"), F.max("ts").alias("last"))
    n, due = F.col("n"), F.col("last") + F.col("n") * 3600 - 2 * 86_400
    int_ = lambda c, name: c.cast("int").alias(name)
    return g.select(
        "learner_id", "deck", "card_id", int_((n + F.col("card_id")) % 5, "state"), int_(n % 2, "step"), (F.col("r") * F.lit(1.5) / n).alias("stability"), (F.lit(1.0) + n % 10).alias("difficulty"),
        int_(n, "reps"), int_(F.col("again"), "lapses"), int_((n + F.col("r")) % 8, "flags"), due.alias("due_ts"), F.floor((due - 14_400) / 86_400).cast("long").alias("due_day"),
        F.col("last").alias("last_review"), n.alias("total_answers"), int_(n % 4, "prev_state"),
    )


CARDS = """cards AS (
  SELECT learner_id, deck, card_id, ((n + card_id) % 5)::INTEGER AS state, (n % 2)::INTEGER AS step, r::DOUBLE * 1.5::DOUBLE / n AS stability, 1.0::DOUBLE + n % 10 AS difficulty, n::INTEGER AS reps, again::INTEGER AS lapses,
    ((n + r) % 8)::INTEGER AS flags, last + n * 3600 - 172800 AS due_ts, floor((last + n * 3600 - 172800 - 14400) / 86400)::BIGINT AS due_day, last AS last_review, n AS total_answers, (n % 4)::INTEGER AS prev_state
  FROM (SELECT learner_id, deck, card_id, count(*) AS n, sum(coalesce(rating, 0))::BIGINT AS r, count(*) FILTER (rating = 1) AS again, max(ts) AS last FROM review_events GROUP BY ALL))"""


def image_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review log with after images, and removals among its events."""
    e = review_events(spark, sf_dir)
    seq = F.col("seq")
    return e.select(
        *[c for c in e.columns if c != "type"], F.when(F.col("type") == "undo", "undo").when(seq % 11 == 0, "remove").when(seq % 7 == 0, "update").otherwise("review").alias("type"),
        (seq % 4).cast("int").alias("state"), (seq % 3).cast("int").alias("step"), (F.col("ts") % 1000 / F.lit(10.0)).alias("stability"), (F.lit(1.0) + seq % 9).alias("difficulty"),
        (seq % 20).cast("int").alias("reps"), (seq % 5).cast("int").alias("lapses"), (seq % 8).cast("int").alias("flags"), (F.col("ts") + seq % 50 * 3600).alias("due_ts"), F.col("ts").alias("last_review"),
    )


IMAGE_EVENTS = """image_events AS (
  SELECT learner_id, deck, card_id, device_id, seq, ts, rating, CASE WHEN type = 'undo' THEN 'undo' WHEN seq % 11 = 0 THEN 'remove' WHEN seq % 7 = 0 THEN 'update' ELSE 'review' END AS type,
    (seq % 4)::INTEGER AS state, (seq % 3)::INTEGER AS step, (ts % 1000) / 10.0::DOUBLE AS stability, 1.0::DOUBLE + seq % 9 AS difficulty, (seq % 20)::INTEGER AS reps, (seq % 5)::INTEGER AS lapses,
    (seq % 8)::INTEGER AS flags, ts + seq % 50 * 3600 AS due_ts, ts AS last_review FROM review_events)"""


def custom_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks of entries by the type of the events on them."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("deck_id"), F.initcap("event_type").alias("name"), F.col("user_id").cast("long").alias("ent_seq")).distinct()


CUSTOM_DECKS = "custom_decks AS (SELECT DISTINCT event_type AS deck_id, upper(event_type[1]) || event_type[2:] AS name, user_id::BIGINT AS ent_seq FROM events)"
