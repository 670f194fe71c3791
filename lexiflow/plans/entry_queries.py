"""Queries over nested entries and over readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..operators import replay as R
from ..operators import search as Q
from ..operators import stats as A
from ..sources import history as H
from ..sources import tables as T
from ..sources.xml import read_lexicon
from ..storage import fresh_path
from ..streaming import events as E
from . import views as W
from .registry import query
from .review_queries import SHOWN, _replay_sql, _rounded

EN = W.sql(W.ENTRIES)
_HEAD = "CASE WHEN len(kebs) > 0 THEN kebs[1] ELSE rebs[1] END"


@query("p1_lookup_by_key", EN + f", k AS (SELECT DISTINCT user_id::BIGINT * 3 AS ent_seq FROM events) SELECT k.ent_seq, CASE WHEN e.ent_seq IS NULL THEN '[unknown]' ELSE {_HEAD} END AS headword FROM k LEFT JOIN entries e ON e.ent_seq = k.ent_seq AND k.ent_seq <> 0")
def p1(spark, sf):
    keys = W.table(spark, sf, "events").select((F.col("user_id").cast("long") * 3).alias("ent_seq")).distinct()
    return L.lookup(W.entries(spark, sf), keys).select("ent_seq", L.headword().alias("headword"))


@query("p1_stored_lookup", EN + f", k AS (SELECT DISTINCT user_id::BIGINT * 3 AS ent_seq FROM events WHERE user_id % 50 = 7) SELECT k.ent_seq, CASE WHEN e.ent_seq IS NULL THEN '[unknown]' ELSE {_HEAD} END AS headword FROM k LEFT JOIN entries e ON e.ent_seq = k.ent_seq AND k.ent_seq <> 0")
def p1_stored(spark, sf):
    """Some keys against a table that is written first: of its blocks only those of the keys are read."""
    at = fresh_path(spark, "lookup")
    T.write_lookup(W.entries(spark, sf), at, rows=100)
    keys = W.table(spark, sf, "events").where("user_id % 50 = 7").select((F.col("user_id").cast("long") * 3).alias("ent_seq")).distinct()
    return L.lookup(T.read_lookup(spark, at, keys), keys).select("ent_seq", L.headword().alias("headword"))


@query("p2_lookup_by_ordinal", EN + " SELECT ent_seq, row_number() OVER (ORDER BY ent_seq) - 1 AS entry_idx FROM entries")
def p2(spark, sf):
    return L.with_ordinal(W.entries(spark, sf)).select("ent_seq", "entry_idx")


@query("p3_p4_p5_heads", EN + f" SELECT ent_seq, {_HEAD} AS headword, CASE WHEN len(kebs) > 1 THEN kebs[2] ELSE '' END AS variants, array_to_string(rebs, '・') AS readings FROM entries")
def p3(spark, sf):
    return W.entries(spark, sf).select("ent_seq", L.headword().alias("headword"), L.variants().alias("variants"), L.readings().alias("readings"))


@query("p6_gloss_in_languages", EN + " SELECT ent_seq, CASE WHEN len(de) > 0 THEN de[1] ELSE es[1] END AS gloss FROM entries")
def p6(spark, sf):
    return W.entries(spark, sf).select("ent_seq", L.gloss_in(["de", "es"]).alias("gloss"))


@query("p7_first_meaning", EN + " SELECT ent_seq, CASE WHEN len(de) > 0 THEN de[1] ELSE '' END AS meaning FROM entries")
def p7(spark, sf):
    return W.entries(spark, sf).select("ent_seq", L.first_meaning().alias("meaning"))


@query("p8_full_view", W.sql(W.LEXICON) + " SELECT ent_seq, head AS headword, CASE WHEN has_k THEN p_name || '|' || p_brand ELSE '' END AS kanji, first || '|' || last AS readings, '0:en:' || glosses || '|1:es:' || p_brand AS senses FROM lexicon")
def p8(spark, sf):
    v = L.full_view(_lexicon(spark, sf), ["en", "es"])
    told = F.transform("senses", lambda s: F.concat_ws(":", s["i"].cast("string"), s["lang"], F.array_join(s["gloss"], ";")))
    return v.select("ent_seq", "headword", F.array_join("kanji.keb", "|").alias("kanji"), F.array_join("readings.reb", "|").alias("readings"), F.array_join(told, "|").alias("senses"))


@query("p9_p10_restrictions", EN + " SELECT ent_seq, CASE WHEN len(kebs) > 0 THEN 1 END::INTEGER AS brand_at, CASE WHEN len(kebs) > 0 THEN p_brand ELSE '' END AS back FROM entries")
def p9(spark, sf):
    p = W.table(spark, sf, "part").select(F.col("p_partkey").alias("ent_seq"), "p_brand")
    rows = W.entries(spark, sf).join(p, "ent_seq")
    places = L.restriction_places(F.array(F.col("p_brand")), F.col("k_ele.keb"))
    return rows.select("ent_seq", F.get(places, F.lit(0)).cast("int").alias("brand_at"), F.array_join(L.restricted_forms(places, F.col("k_ele.keb")), "").alias("back"))


def _lexicon(spark, sf):
    """The lexicon written as XML and read again."""
    at = fresh_path(spark, "lexicon")
    W.write_lexicon(spark, sf, at)
    return read_lexicon(spark, at)


def _told_forms(df):
    """Forms with their marks in brackets, as text."""
    put = lambda *c: F.concat(c[0], *[F.concat(F.lit("("), x, F.lit(")")) for x in c[1:]])
    semi = lambda c: F.array_join(c, ";")
    kanji = F.transform("k_ele", lambda k: put(k["keb"], semi(k["ke_inf"]), semi(k["ke_pri"])))
    reading = F.transform("r_ele", lambda r: put(r["reb"], r["re_nokanji"].cast("string"), semi(r["re_restr"]), semi(r["re_inf"]), semi(r["re_pri"])))
    return df.withColumn("kanji", F.array_join(kanji, "|")).withColumn("readings", F.array_join(reading, "|"))


def _told_lists(s):
    source = F.transform(s["lsource"], lambda x: F.concat_ws(",", x["text"], x["part"].cast("string"), x["wasei"].cast("string")))
    return F.concat_ws(":", s["lang"], F.array_join(s["gloss"], ";"), *[F.array_join(s[c], ";") for c in L.SENSE_LISTS], F.array_join(source, ";"))


LX = W.sql(W.LEXICON)


@query("s1_lexicon_xml", LX + " SELECT ent_seq, kanji, readings, 'en:' || glosses || ':' || lists || ':' || lsource || ':' || last || '・' || p_brand || ':' || p_brand || '|es:' || p_brand || ':::::::::' || ':' || CASE WHEN n % 9 = 0 THEN '|unk:' || p_name || ':::::::::' || ':' ELSE '' END AS senses FROM lexicon")
def s1(spark, sf):
    told = F.transform("senses", lambda s: F.concat_ws(":", _told_lists(s), F.array_join(s["xref"], ";"), F.array_join(s["ant"], ";")))
    return _told_forms(_lexicon(spark, sf)).select("ent_seq", "kanji", "readings", F.array_join(told, "|").alias("senses"))


@query("f20_gloss_types", LX + " SELECT lang, g_type, count(*) AS n FROM (SELECT 'en' AS lang, g_type FROM lexicon UNION ALL SELECT 'en', 'none' FROM lexicon UNION ALL SELECT 'es', 'none' FROM lexicon UNION ALL SELECT 'unk', 'none' FROM lexicon WHERE n % 9 = 0) GROUP BY ALL")
def f20(spark, sf):
    senses = _lexicon(spark, sf).select(F.explode("senses").alias("s"))
    return senses.select("s.lang", F.explode("s.g_type").alias("g_type")).groupBy("lang", F.coalesce("g_type", F.lit("none")).alias("g_type")).agg(F.count(F.lit(1)).alias("n"))


@query("f21_loan_sources", LX + " SELECT ent_seq, p_brand AS text, n % 2 = 1 AS part, n % 3 = 0 AS wasei FROM lexicon")
def f21(spark, sf):
    return _lexicon(spark, sf).select("ent_seq", F.inline(F.flatten("senses.lsource")))


@query(
    "p8_entry_page",
    LX + """, forms AS (SELECT ent_seq, p_name AS t FROM lexicon WHERE has_k UNION ALL SELECT ent_seq, p_brand FROM lexicon WHERE has_k UNION ALL SELECT ent_seq, first FROM lexicon UNION ALL SELECT ent_seq, last FROM lexicon),
    f AS (SELECT t, min(ent_seq) AS id FROM forms GROUP BY t)
    SELECT l.ent_seq, l.head AS headword, l.kanji, l.readings, '0:' || l.g_type || ';none:en:' || l.glosses || ':' || l.lists || ':' || l.lsource || ':' || x.id || '=' || xl.head || ':' || coalesce(a.id || '=' || al.head, '') || '|1:none:es:' || l.p_brand || '::::::::::' AS senses
    FROM lexicon l LEFT JOIN f x ON x.t = l.last LEFT JOIN lexicon xl ON xl.ent_seq = x.id LEFT JOIN f a ON a.t = l.p_brand LEFT JOIN lexicon al ON al.ent_seq = a.id""",
)
def p8_page(spark, sf):
    """Every list of every sense in two languages, references resolved, over the lexicon that was read from XML."""
    v = L.full_view(_lexicon(spark, sf), ["en", "es"]).withColumnsRenamed({"kanji": "k_ele", "readings": "r_ele"})
    links = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["id"].cast("string"), x["label"])), ";")
    types = lambda c: F.array_join(F.transform(c, lambda t: F.coalesce(t, F.lit("none"))), ";")
    told = F.transform("senses", lambda s: F.concat_ws(":", s["i"].cast("string"), types(s["g_type"]), _told_lists(s), links(s["xref"]), links(s["ant"])))
    return _told_forms(v).select("ent_seq", "headword", "kanji", "readings", F.array_join(told, "|").alias("senses"))


TERMS = EN + """, t AS (
  SELECT ent_seq, unnest(kebs) AS text, generate_subscripts(kebs, 1) - 1 AS meta1, 0 AS meta2, 'kanji' AS kind, 'jp' AS lang FROM entries
  UNION ALL SELECT ent_seq, text, min(i), 0, 'reading', 'jp' FROM (SELECT ent_seq, unnest(rebs) AS text, generate_subscripts(rebs, 1) - 1 AS i FROM entries) GROUP BY ent_seq, text
  UNION ALL SELECT ent_seq, unnest(de), 0, generate_subscripts(de, 1) - 1, 'gloss', 'de' FROM entries
  UNION ALL SELECT ent_seq, unnest(en), 1, generate_subscripts(en, 1) - 1, 'gloss', 'en' FROM entries
  UNION ALL SELECT ent_seq, unnest(es), 2, generate_subscripts(es, 1) - 1, 'gloss', 'es' FROM entries),
terms AS (SELECT t.*, (len(e.pris) > 0 AND coalesce(e.pris[1], '') <> 'oth1')::INTEGER AS common FROM t JOIN entries e USING (ent_seq))"""


def _terms(df):
    return df.select("ent_seq", "text", F.col("meta1").cast("int").alias("meta1"), F.col("meta2").cast("int").alias("meta2"), "lang", "common")


@query("s3_term_export", TERMS + " SELECT ent_seq, text, meta1::INTEGER AS meta1, meta2::INTEGER AS meta2, lang, common FROM terms")
def s3(spark, sf):
    at = fresh_path(spark, "terms")
    T.write_terms(L.terms(W.entries(spark, sf)), at)
    return _terms(T.read_versioned(spark, at))


@query("s4_term_import", TERMS + " SELECT ent_seq, text, meta1::INTEGER AS meta1, meta2::INTEGER AS meta2, common, octet_length(text::BLOB)::INTEGER AS n_bytes FROM terms")
def s4(spark, sf):
    at = fresh_path(spark, "tsv")
    T.write_terms(L.terms(W.entries(spark, sf)), at, tsv=True)
    return T.read_terms_tsv(spark, f"{at}/lang=*").select("ent_seq", "text", "meta1", "meta2", "common", "n_bytes")


@query("s4_term_lines", "SELECT doc_id AS ent_seq, 'line ' || n_chars AS text, (n_chars % 7)::INTEGER AS meta1, 0 AS meta2, 0 AS common FROM documents WHERE doc_id % 5 <> 0")
def s4_lines(spark, sf):
    n, c = F.col("doc_id"), F.col("n_chars")
    line = F.concat_ws("\t", F.when(n % 5 == 0, F.concat(F.lit("#"), n.cast("string"))).otherwise(n.cast("string")), F.concat(F.lit("line "), c.cast("string")), (c % 7).cast("string"), F.lit(""))
    return T.parse_term_lines(W.table(spark, sf, "documents").select(line.alias("value")))


@query("s2_entry_table", EN + f" SELECT ent_seq, {_HEAD} AS headword, 3 AS n_senses FROM entries")
def s2(spark, sf):
    at = fresh_path(spark, "entries")
    T.write_entries(W.entries(spark, sf), at)
    return T.read_versioned(spark, at).select("ent_seq", L.headword().alias("headword"), F.size("senses").alias("n_senses"))


@query("s5_reference_table", "SELECT p_partkey AS ent_seq, 0 AS sense_i, kind, i::INTEGER AS i, CASE WHEN kind = 'ant' THEN p_brand WHEN i = 0 THEN p_name ELSE p_type END AS target FROM part, (VALUES ('xref', 0), ('xref', 1), ('ant', 0)) v(kind, i)")
def s5(spark, sf):
    p = W.table(spark, sf, "part")
    sense = F.struct(F.array("p_name", "p_type").alias("xref"), F.array("p_brand").alias("ant"))
    return L.unresolved_references(p.select(F.col("p_partkey").alias("ent_seq"), F.array(sense).alias("senses")))


@query("s6_posting_table", W.sql(W.LEX_TERMS) + " SELECT lang, length(gram)::INTEGER AS n, count(*) AS c FROM (SELECT DISTINCT lang, ent_seq, meta1, unnest(CASE WHEN length(text) >= 3 THEN list_transform(range(1, (length(text) - 1)::BIGINT), lambda i: substr(text, i, 3)) ELSE [text] END) AS gram FROM lex_terms) GROUP BY ALL")
def s6(spark, sf):
    at = fresh_path(spark, "postings")
    T.write_index(W.lex_terms(spark, sf), at)
    return T.read_postings(spark, at).groupBy("lang", F.length("gram").alias("n")).agg(F.count(F.lit(1)).alias("c"))


@query("s6_pruned_postings", W.sql(W.LEX_TERMS) + " SELECT gram, count(*) AS n FROM (SELECT DISTINCT lang, ent_seq, meta1, unnest(CASE WHEN length(text) >= 3 THEN list_transform(range(1, (length(text) - 1)::BIGINT), lambda i: substr(text, i, 3)) ELSE [text] END) AS gram FROM lex_terms WHERE text <> '') WHERE gram IN ('the', 'und', 'zzz', 'qu ') GROUP BY gram")
def s6_pruned(spark, sf):
    """A few grams, a frequent one among them, from an index of small buckets: it is split over several, and only those asked for are read."""
    at = fresh_path(spark, "postings")
    T.write_index(W.lex_terms(spark, sf), at, rows=20_000)
    asked = spark.createDataFrame([("the",), ("und",), ("zzz",), ("qu ",)], "gram string")
    return T.read_postings(spark, at, asked).join(asked, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


IM = W.sql(W.REVIEW_EVENTS, W.IMAGE_EVENTS)


@query("s7_s8_event_log", IM + " SELECT device_id, seq, type FROM image_events")
def s7(spark, sf):
    at = fresh_path(spark, "log")
    e = W.image_events(spark, sf)
    T.append_events(e.where("seq % 2 = 0"), at)
    T.append_events(e.where("seq % 2 = 1"), at)
    return T.sound_events(T.read_events(spark, at))[0].select("device_id", "seq", "type")


@query("s8_quarantine", IM + " SELECT seq, type, CASE WHEN seq % 13 = 0 THEN 'device' WHEN seq % 17 = 0 THEN 'time' ELSE 'type' END AS lacks FROM image_events WHERE seq % 13 = 0 OR seq % 17 = 0 OR seq % 19 = 0")
def s8(spark, sf):
    """Torn records among the events: without device, without time, of an unknown type."""
    seq = F.col("seq")
    torn = W.image_events(spark, sf).withColumn("device_id", F.when(seq % 13 != 0, F.col("device_id"))).withColumn("ts", F.when(seq % 17 != 0, F.col("ts")))
    rows = torn.select("*", F.col("type").alias("was")).withColumn("type", F.when(seq % 19 == 0, "torn").otherwise(F.col("type")))
    lacks = F.when(F.col("device_id").isNull(), "device").when(F.col("ts").isNull(), "time").otherwise("type")
    return T.sound_events(rows)[1].select("seq", F.col("was").alias("type"), lacks.alias("lacks"))


def _torn(rows):
    """Some events without device, without time, or of an unknown type."""
    seq = F.col("seq")
    torn = rows.withColumn("device_id", F.when(seq % 13 != 0, F.col("device_id"))).withColumn("ts", F.when(seq % 17 != 0, F.col("ts")))
    return torn.withColumn("type", F.when(seq % 19 == 0, "torn").otherwise(F.col("type")))


@query("s8_sorting_sink", IM + " SELECT seq, CASE WHEN seq % 13 = 0 THEN 'device' WHEN seq % 17 = 0 THEN 'time' WHEN seq % 19 = 0 THEN 'type' END AS lacks FROM image_events")
def s8_sink(spark, sf):
    """A stream into both tables, with its last batches given once more."""
    at = fresh_path(spark, "sorted")
    sink, given = E.sorting_sink(at), []

    def put(batch, batch_id):
        sink(_torn(batch), batch_id)
        given.append(batch_id)
        if batch_id:
            sink(_torn(batch), batch_id)

    source = f"{at}/in"
    events = W.image_events(spark, sf).repartition(4, "seq")
    events.write.parquet(source)
    spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    sound = spark.read.schema("seq long").parquet(f"{at}/events").select("seq", F.lit(None).cast("string").alias("lacks"))
    return sound.unionByName(spark.read.schema("seq long, lacks string").parquet(f"{at}/quarantine").select("seq", "lacks"))


CA = W.sql(W.REVIEW_EVENTS, W.CARDS)


@query("s9_s10_deck_tables", CA + " SELECT learner_id, deck, card_id, state, due_ts FROM cards")
def s9(spark, sf):
    at = fresh_path(spark, "deck")
    answers = W.review_events(spark, sf).where("type = 'review'").withColumn("prev_state", F.lit(0))
    T.save_deck(W.cards(spark, sf), A.day_counters(answers), at)
    return T.load_deck(spark, at)[0].select(*R.CARD, "state", "due_ts")


@query("s10_deck_reload", CA + f", c AS (SELECT learner_id, deck, count(*) AS cards, sum(reps)::BIGINT AS reps FROM cards GROUP BY ALL), d AS (SELECT learner_id, deck, count(*) AS cards_done FROM review_events WHERE type = 'review' AND floor((ts - 14400) / 86400) = {(W.NOW - 14400) // 86400} GROUP BY ALL) SELECT c.*, coalesce(cards_done, 0) AS cards_done FROM c LEFT JOIN d USING (learner_id, deck)")
def s10(spark, sf):
    """Decks and counters written and read again: the cards of each deck, and what was done on the day that counts."""
    at = fresh_path(spark, "deck")
    answers = W.review_events(spark, sf).where("type = 'review'").withColumn("prev_state", F.lit(0))
    T.save_deck(W.cards(spark, sf), A.day_counters(answers), at)
    cards, counters = T.load_deck(spark, at)
    today = T.counters_of_day(counters, (W.NOW - 14_400) // 86_400).select("learner_id", "deck", "cards_done")
    decks = cards.groupBy("learner_id", "deck").agg(F.count(F.lit(1)).alias("cards"), F.sum("reps").alias("reps"))
    return decks.join(today, ["learner_id", "deck"], "left").select("learner_id", "deck", "cards", "reps", F.coalesce("cards_done", F.lit(0)).alias("cards_done"))


@query("s11_history_chunks", W.sql(W.REVIEW_EVENTS) + " SELECT learner_id, chunk::INTEGER AS chunk, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, (row_number() OVER (PARTITION BY learner_id ORDER BY ts, device_id, seq) - 1) // 1000 AS chunk FROM review_events) GROUP BY ALL")
def s11(spark, sf):
    return T.history_chunks(W.review_events(spark, sf))


_CHUNKED = "(seq * 3 // (SELECT max(seq) + 1 FROM review_events))"


@query("s11_history_appends", W.sql(W.REVIEW_EVENTS) + f""" SELECT learner_id, chunk::INTEGER AS chunk, count(*) AS n, sum(place)::BIGINT AS places, min(seq) AS first_seq, max(seq) AS last_seq FROM (
  SELECT learner_id, seq, k // 1000 AS chunk, k % 1000 AS place FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY {_CHUNKED}, ts, device_id, seq) - 1 AS k FROM review_events)) GROUP BY ALL""")
def s11_appends(spark, sf):
    """Three appends, the second one twice: each goes on in the chunk that the one before left open."""
    at = fresh_path(spark, "history")
    events = W.review_events(spark, sf)
    most = events.agg(F.max("seq") + 1).first()[0]
    for k in (0, 1, 1, 2):
        H.append_chunks(events.where(F.floor(F.col("seq") * 3 / most) == k), at, k)
    return H.read_chunks(spark, at).groupBy("learner_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


_KINDS = "CASE WHEN type = 'review' AND seq % 13 = 0 THEN 'suspend' WHEN type = 'review' AND seq % 17 = 0 THEN 'add' ELSE type END"
_OWN = "{'ts': ts, 'device_id': device_id, 'seq': seq, 'type': type, 'state': state, 'stability': stability, 'due_ts': due_ts}"


@query(
    "s12_history_images",
    IM + f""", e AS (SELECT * REPLACE ({_KINDS} AS type) FROM image_events),
    d AS (SELECT *, {_OWN} AS own, sum(CASE type WHEN 'review' THEN 1 WHEN 'undo' THEN -1 ELSE 0 END) OVER (PARTITION BY learner_id, deck, card_id ORDER BY ts, device_id, seq) AS depth FROM e),
    t AS (SELECT *, last_value(CASE WHEN type = 'review' THEN own END IGNORE NULLS) OVER (PARTITION BY learner_id, deck, card_id, depth ORDER BY ts, device_id, seq ROWS UNBOUNDED PRECEDING) AS top,
      last_value(CASE WHEN type NOT IN ('review', 'undo') THEN own END IGNORE NULLS) OVER (PARTITION BY learner_id, deck, card_id ORDER BY ts, device_id, seq ROWS UNBOUNDED PRECEDING) AS other FROM d),
    n AS (SELECT *, CASE WHEN other IS NULL THEN top WHEN top IS NULL OR (other.ts, other.device_id, other.seq) > (top.ts, top.device_id, top.seq) THEN other ELSE top END AS now FROM t),
    w AS (SELECT *, lag(now) OVER (PARTITION BY learner_id, deck, card_id ORDER BY ts, device_id, seq) AS was FROM n),
    i AS (SELECT *, CASE WHEN type IN ('remove', 'suspend') THEN was WHEN type = 'undo' THEN now ELSE own END AS image FROM w)
    SELECT seq, CASE type WHEN 'review' THEN 'answer' WHEN 'update' THEN 'unsuspend' ELSE type END AS kind, rating, CASE WHEN image.type <> 'remove' THEN image.state END AS state,
      CASE WHEN image.type <> 'remove' THEN image.stability END AS stability, CASE WHEN image.type <> 'remove' THEN image.due_ts END AS due_ts FROM i""",
)
def s12_images(spark, sf):
    kind = F.when((F.col("type") == "review") & (F.col("seq") % 13 == 0), "suspend").when((F.col("type") == "review") & (F.col("seq") % 17 == 0), "add").otherwise(F.col("type"))
    return H.history_images(W.image_events(spark, sf).withColumn("type", kind)).select("seq", "kind", "rating", "state", "stability", "due_ts")


@query("s12_history_kinds", W.sql(W.REVIEW_EVENTS) + " SELECT learner_id, deck, card_id, device_id, seq, ts, CASE WHEN type <> 'review' THEN type WHEN row_number() OVER w = 1 THEN 'add' ELSE 'answer' END AS kind, lag(rating) OVER w AS before_rating, rating AS after_rating FROM review_events WINDOW w AS (PARTITION BY learner_id, deck, card_id ORDER BY ts, device_id, seq)")
def s12(spark, sf):
    return T.history_events(W.review_events(spark, sf))


@query("s13_custom_decks", W.sql(W.CUSTOM_DECKS) + " SELECT deck_id AS id, name, count(*) AS n, sum(ent_seq)::BIGINT AS total FROM custom_decks GROUP BY ALL")
def s13(spark, sf):
    at = fresh_path(spark, "decks")
    T.write_custom_decks(W.custom_decks(spark, sf), at)
    back = T.read_custom_decks(spark, at, lines=True)
    return back.groupBy(F.col("deck_id").alias("id"), "name").agg(F.count(F.lit(1)).alias("n"), F.sum("ent_seq").alias("total"))


@query("s14_custom_deck_edit", W.sql(W.CUSTOM_DECKS) + " SELECT deck_id, count(*) AS n FROM (SELECT deck_id, ent_seq FROM custom_decks WHERE deck_id <> 'error' UNION ALL SELECT DISTINCT 'fresh', ent_seq FROM custom_decks) GROUP BY deck_id")
def s14(spark, sf):
    d = W.custom_decks(spark, sf)
    added = d.select(F.lit("fresh").alias("deck_id"), F.lit("Fresh").alias("name"), "ent_seq").distinct()
    return T.edit_custom_decks(d, added, d.where("deck_id = 'error'").select("deck_id").distinct()).groupBy("deck_id").agg(F.count(F.lit(1)).alias("n"))


@query("s15_day_counters", W.sql(W.REVIEW_EVENTS) + f" SELECT learner_id, deck, count(*) AS cards_done FROM review_events WHERE type = 'review' AND floor((ts - 14400) / 86400) = {(W.NOW - 14400) // 86400} GROUP BY ALL")
def s15(spark, sf):
    answers = W.review_events(spark, sf).where("type = 'review'").withColumn("prev_state", F.lit(0))
    return T.counters_of_day(A.day_counters(answers), (W.NOW - 14400) // 86400).select("learner_id", "deck", "cards_done")


REFS = W.sql(W.ENTRIES, W.REFERENCES) + """, forms AS (SELECT ent_seq, unnest(kebs) AS text, 'k' AS k FROM entries UNION ALL SELECT ent_seq, unnest(rebs), 'r' FROM entries),
first AS (SELECT text, min(ent_seq) AS any_seq, min(ent_seq) FILTER (k = 'r') AS reading_seq FROM forms GROUP BY text),
res AS (SELECT r.*, least(a.any_seq, b.reading_seq) AS target_seq FROM refs r LEFT JOIN first a ON a.text = string_split(target, '・')[1] LEFT JOIN first b ON b.text = string_split(target, '・')[2])"""


@query("j1_reference_resolution", REFS + " SELECT ent_seq, sense_i, kind, i, target, target_seq FROM res")
def j1(spark, sf):
    return L.resolve_references(W.references(spark, sf), W.entries(spark, sf)).select("ent_seq", "sense_i", "kind", "i", "target", "target_seq")


@query("j2_reference_headwords", REFS + f" SELECT res.ent_seq, res.kind, {_HEAD} AS words FROM res JOIN entries e ON e.ent_seq = res.target_seq")
def j2(spark, sf):
    resolved = L.resolve_references(W.references(spark, sf), W.entries(spark, sf))
    return L.reference_headwords(resolved, W.entries(spark, sf)).select("ent_seq", "kind", F.array_join("words", ",").alias("words"))


# ------------------------------------------------------------------ streams, each run over the whole table and then read


def _source(spark, sf, files=8):
    """The event table as files of about equal size that a stream reads: (folder, schema, place of the checkpoint)."""
    at = fresh_path(spark, "stream")
    events = W.review_events(spark, sf).repartition(files, "seq")
    events.write.parquet(f"{at}/in")
    return f"{at}/in", events.schema, f"{at}/check"


def _run(spark, sf, make):
    """Write what ``make`` does to the event stream, some files at a time, into a table, until all that is there is read."""
    source, schema, check = _source(spark, sf)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(source)
    out = f"{source}-out"
    make(stream).option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return out


@query("x1_stream_dedupe", W.sql(W.REVIEW_EVENTS) + " SELECT device_id, seq, type FROM review_events")
def x1(spark, sf):
    twice = lambda s: s.unionByName(s)
    out = _run(spark, sf, lambda s: E.deduplicated(twice(s), "90 days").select("device_id", "seq", "type").writeStream.format("parquet"))
    return spark.read.schema("device_id decimal(20,0), seq long, type string").parquet(out)


@query("x2_stream_last_writer", W.sql(W.REVIEW_EVENTS) + " SELECT learner_id, deck, card_id, device_id, seq FROM review_events WHERE type <> 'undo' QUALIFY row_number() OVER (PARTITION BY learner_id, deck, card_id ORDER BY ts DESC, device_id DESC, seq DESC) = 1")
def x2(spark, sf):
    at = fresh_path(spark, "winners")
    _run(spark, sf, lambda s: s.writeStream.foreachBatch(E.last_writer_sink(at)))
    return E.read_winners(spark, at, W.review_events(spark, sf).schema).select(*R.CARD, "device_id", "seq")


def _card_stream(spark, source, schema, check, put, **options):
    """Run the card states over a folder of events until all is read; the state store is set for this stream alone."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(source)
        E.streaming_cards(stream, **options).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def _last_states(spark, at):
    last = spark.read.parquet(at).groupBy(*R.CARD).agg(F.max_by(F.struct(*R.FIELDS, "lost"), "batch").alias("c")).select(*R.CARD, "c.*")
    return _rounded(last.where("total_answers > 0")).drop("prev_state")


def _put(at):
    """Batches are numbered and written once each; the last row of a card holds."""

    def put(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{at}/part={batch_id:06d}")

    return put


def _n_cards():
    """About how many cards there are."""
    return F.approx_count_distinct(F.xxhash64(*R.CARD))


@query("x3_stream_cards", _replay_sql() + f" SELECT {SHOWN} FROM final")
def x3(spark, sf):
    """The state of every card after the last batch, for events that come in no order within their whole time."""
    at = fresh_path(spark, "cards")
    source, schema, check = _source(spark, sf)
    n = W.review_events(spark, sf).agg(_n_cards()).first()[0]
    _card_stream(spark, source, schema, check, _put(at), lateness="90 days", buckets=E.buckets_for(n))
    return _last_states(spark, at).drop("lost")


@query("x3_stream_settled", _replay_sql() + f" SELECT {SHOWN}, FALSE AS lost FROM final")
def x3_settled(spark, sf):
    """The same for events that come day by day, each day out of order: what the watermark has passed is settled, and its events leave the state."""
    at = fresh_path(spark, "settled")
    source, check = f"{at}/in", f"{at}/check"
    events = W.review_events(spark, sf)
    days = events.agg(F.min("ts"), F.max("ts"), _n_cards()).first()
    for k in range(3):
        third = F.floor((F.col("ts") - days[0]) * 3 / (days[1] - days[0] + 1)) == k
        events.where(third).repartition(2, "seq").write.mode("append").parquet(source)
        _card_stream(spark, source, events.schema, check, _put(f"{at}/out"), lateness="12 days", buckets=E.buckets_for(days[2]))
    return _last_states(spark, f"{at}/out")


@query("x4_daily_activity", W.sql(W.REVIEW_EVENTS) + " SELECT learner_id, deck, type, floor((ts - 14400) / 86400)::BIGINT AS day, count(*) AS n FROM review_events GROUP BY ALL")
def x4(spark, sf):
    """The streaming aggregate over the table as a bounded stream; the same function serves ``readStream``."""
    day = F.floor((F.unix_timestamp(F.col("window.start")) - 14400) / 86400).cast("long").alias("day")
    return E.daily_activity(W.review_events(spark, sf)).select("learner_id", "deck", "type", day, "n")


@query("x4_stream_daily_activity", W.sql(W.REVIEW_EVENTS) + " SELECT learner_id, deck, type, floor((ts - 14400) / 86400)::BIGINT AS day, count(*) AS n FROM review_events GROUP BY ALL")
def x4_stream(spark, sf):
    """The same aggregate over a real stream in several batches; each batch gives the new counts of the days that it touched, and the last ones are read."""
    at = fresh_path(spark, "activity")

    def put(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(at)

    _run(spark, sf, lambda s: E.daily_activity(s, lateness="90 days").writeStream.outputMode("update").foreachBatch(put))
    day = F.floor((F.unix_timestamp(F.col("window.start")) - 14400) / 86400).cast("long").alias("day")
    key = ["learner_id", "deck", "type", day]
    return spark.read.parquet(at).groupBy(*key).agg(F.max_by("n", "batch").alias("n"))


@query("x5_audit_log", W.sql(W.REVIEW_EVENTS) + " SELECT device_id, seq, type, ts FROM review_events")
def x5(spark, sf):
    source, schema, check = _source(spark, sf)
    out = f"{source}-out"
    E.append_audit(E.event_stream(spark, source, schema).select("device_id", "seq", "type", "ts"), out, check).awaitTermination()
    return spark.read.schema("device_id decimal(20,0), seq long, type string, ts long").parquet(out)


@query("x6_stream_late_events", W.sql(W.REVIEW_EVENTS) + ", mark AS (SELECT max(ts) - 7 * 86400 AS mark FROM review_events WHERE seq % 2 = 0) SELECT learner_id, count(*) AS n, count(*) FILTER (seq % 2 = 1 AND ts <= mark) AS n_late FROM review_events, mark GROUP BY learner_id")
def x6_stream(spark, sf):
    """Even events come first and odd ones after the watermark has passed: what deduplication lets through less than came is what was too late."""
    at = fresh_path(spark, "late")
    events = W.review_events(spark, sf)

    def go():
        stream = E.deduplicated(E.event_stream(spark, f"{at}/in", events.schema)).select("learner_id", "device_id", "seq")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/check").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()

    for half in (0, 1):
        events.where(F.col("seq") % 2 == half).write.mode("append").parquet(f"{at}/in")
        go()
    kept = spark.read.schema("learner_id long, device_id decimal(20,0), seq long").parquet(f"{at}/out").groupBy("learner_id").agg(F.count(F.lit(1)).alias("kept"))
    n = events.groupBy("learner_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(kept, "learner_id", "left").select("learner_id", "n", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("n_late"))


@query("x6_stream_dropped", W.sql(W.REVIEW_EVENTS) + ", mark AS (SELECT max(ts) - 7 * 86400 AS mark FROM review_events WHERE seq % 2 = 0) SELECT count(*) FILTER (seq % 2 = 1 AND ts <= mark) AS n_dropped, count(*) AS n FROM review_events, mark")
def x6_dropped(spark, sf):
    """The same count by the stream's own reports, without another look at the events."""
    at = fresh_path(spark, "dropped")
    events, dropped = W.review_events(spark, sf), 0
    for half in (0, 1):
        events.where(F.col("seq") % 2 == half).write.mode("append").parquet(f"{at}/in")
        stream = E.deduplicated(E.event_stream(spark, f"{at}/in", events.schema)).select("device_id", "seq")
        running = stream.writeStream.format("noop").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
        running.awaitTermination()
        dropped += E.dropped_rows(running.recentProgress)
    return events.agg(F.lit(dropped).cast("long").alias("n_dropped"), F.count(F.lit(1)).alias("n"))


@query("x6_late_events", W.sql(W.REVIEW_EVENTS) + f" SELECT learner_id, count(*) FILTER (ts <= {W.NOW - 7 * 86400}) AS n_late FROM review_events GROUP BY learner_id")
def x6(spark, sf):
    return E.late_events(W.review_events(spark, sf), W.NOW - 7 * 86400)
