"""Queries over lines, names and questions: cleaning, scripts, grams, index, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..functions.sql import register
from ..operators import search as Q
from ..sources import tables as T
from ..storage import fresh_path
from . import views as W
from .registry import query

UP, LOW = X.UPPER, X.LOWER
FOLD = f"translate({{}}, '{X.KATAKANA}', '{X.HIRAGANA}')"
TRI = "(CASE WHEN length({t}) >= 3 THEN list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3)) WHEN length({t}) > 0 THEN [{t}] ELSE [] END)"


def _names(spark, sf):
    return W.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")


@query("f1_clean_query", f"SELECT item_id, translate(regexp_replace(text, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'), '{UP}', '{LOW}') AS q FROM benchmark")
def f1(spark, sf):
    return W.table(spark, sf, "benchmark").select("item_id", X.clean_query(F.col("text")).alias("q"))


def _values(rows):
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


#: Whole texts as questions, walked from left to right a spelling at a time.
WALK = f"""asked AS (SELECT item_id AS query_id, translate(regexp_replace(text, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), '{UP}', '{LOW}') AS q_norm FROM benchmark),
romaji(k, v) AS (VALUES {_values(X.romaji_table().items())}),
walk AS (SELECT query_id, q_norm, 1 AS spot, '' AS kana FROM asked UNION ALL
  SELECT w.query_id, q_norm, spot + CASE WHEN two IN ('nn', 'n''') THEN 2 WHEN one = 'n' AND NOT vowel OR twice THEN 1 WHEN r3.k IS NOT NULL THEN 3 WHEN r2.k IS NOT NULL THEN 2 ELSE 1 END,
    kana || CASE WHEN two IN ('nn', 'n''') OR one = 'n' AND NOT vowel THEN 'ん' WHEN twice THEN 'っ' WHEN one = '''' THEN '' ELSE coalesce(r3.v, r2.v, r1.v, one) END
  FROM (SELECT *, q_norm[spot] AS one, q_norm[spot:spot + 1] AS two, contains('aiueoy', q_norm[spot + 1]) AND q_norm[spot + 1] <> '' AS vowel, q_norm[spot] = q_norm[spot + 1] AND regexp_matches(q_norm[spot], '[b-df-hj-mp-tv-z]') AS twice FROM walk WHERE spot <= length(q_norm)) w
  LEFT JOIN romaji r3 ON length(q_norm[spot:spot + 2]) = 3 AND r3.k = q_norm[spot:spot + 2] LEFT JOIN romaji r2 ON length(two) = 2 AND r2.k = two LEFT JOIN romaji r1 ON r1.k = one),
rewritten AS (SELECT query_id, q_norm, {FOLD.format('kana')} AS q_kana FROM walk WHERE spot > length(q_norm))"""
_LONG = "q_kana"
for _vowel, _row in X.VOWEL_ROWS.items():
    _LONG = f"regexp_replace({_LONG}, '([{_row}]){_vowel}', '\\1ー', 'g')"


def _questions(spark, sf):
    return Q.rewrite_queries(W.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q_raw")))


@query("f2_f3_romaji", W.sql(WALK, recursive=True) + " SELECT query_id, q_norm, q_kana FROM rewritten")
def f2(spark, sf):
    return _questions(spark, sf).select("query_id", "q_norm", "q_kana")


@query("f4_fold_kana", f"SELECT doc_id, {FOLD.format('text')} AS folded FROM documents")
def f4(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", X.fold_kana(F.col("text")).alias("folded"))


@query("f5_long_vowels", W.sql(WALK, recursive=True) + f", long AS (SELECT query_id, q_kana, {_LONG} AS q_long FROM rewritten) SELECT *, q_long <> q_kana AS has_long FROM long")
def f5(spark, sf):
    return _questions(spark, sf).select("query_id", "q_kana", "q_long", "has_long")


@query("f6_same_kana", f"SELECT p_partkey, {FOLD.format('p_name')} = {FOLD.format('p_type')} AS same FROM part")
def f6(spark, sf):
    return _names(spark, sf).select("p_partkey", X.same_kana(F.col("p_name"), F.col("p_type")).alias("same"))


@query("f7_kana_position", "SELECT p_partkey, (strpos(p_name, string_split(p_name, ' ')[-1]) - 1)::INTEGER AS pos, (strpos(p_name, 'e') - 1)::INTEGER AS e_pos FROM part")
def f7(spark, sf):
    word = F.element_at(F.split("p_name", " "), -1)
    return _names(spark, sf).select("p_partkey", X.kana_position(F.col("p_name"), word).alias("pos"), X.kana_position(F.col("p_name"), F.lit("e")).alias("e_pos"))


@query(
    "f8_highlight",
    """WITH h AS (SELECT p_partkey, p_name AS t, string_split(p_name, ' ')[-1] AS a, 'e' AS b FROM part),
    s AS (SELECT *, CASE WHEN strpos(t, a) = 0 AND strpos(t, b) = 0 THEN NULL WHEN strpos(t, b) = 0 OR (strpos(t, a) > 0 AND strpos(t, a) <= strpos(t, b)) THEN strpos(t, a) ELSE strpos(t, b) END AS p,
      CASE WHEN strpos(t, b) = 0 OR (strpos(t, a) > 0 AND strpos(t, a) <= strpos(t, b)) THEN length(a) ELSE length(b) END AS n FROM h)
    SELECT p_partkey, (p - 1)::INTEGER AS start, n::INTEGER AS size, substr(t, 1, p - 1) || '<b>' || substr(t, p, n) || '</b>' || substr(t, p + n) AS html FROM s""",
)
def f8(spark, sf):
    rows = _names(spark, sf).withColumn("span", X.match_span(F.col("p_name"), [F.element_at(F.split("p_name", " "), -1), F.lit("e")]))
    return rows.select("p_partkey", "span.start", "span.size", X.highlight(F.col("p_name"), F.col("span")).alias("html"))


@query(
    "f9_script_bits",
    r"SELECT doc_id, (CASE WHEN regexp_matches(text, '[\x{4E00}-\x{9FAF}]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '[\x{3040}-\x{30FF}]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '[\x{0}-\x{7FF}\x{10000}-\x{10FFFF}]') THEN 4 ELSE 0 END)::INTEGER AS bits FROM documents",
)
def f9(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", X.script_bits(F.col("text")).alias("bits"))


@query("f10_length", "SELECT doc_id, length(text)::INTEGER AS n FROM documents")
def f10(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))


@query("f11_grams", "SELECT n, gram, count(*) AS c FROM (SELECT n, unnest(CASE WHEN length(text) >= n THEN list_transform(range(1, (length(text) - n + 2)::BIGINT), lambda i: substr(text, i, n)) ELSE [] END) AS gram FROM documents, (VALUES (1), (2), (3)) v(n)) GROUP BY n, gram")
def f11(spark, sf):
    d = W.table(spark, sf, "documents")
    each = F.array(*[F.struct(F.lit(n).alias("n"), X.grams(F.col("text"), n).alias("g")) for n in (1, 2, 3)])
    return d.select(F.inline(each)).select("n", F.explode("g").alias("gram")).groupBy("n", "gram").agg(F.count(F.lit(1)).alias("c"))


@query("f2_f11_sql_functions", W.sql(WALK, recursive=True) + f", long AS (SELECT query_id, q_kana, {_LONG} AS q_long FROM rewritten) SELECT query_id, q_kana, q_long, greatest(length(q_kana) - 1, 0)::INTEGER AS n_grams, substr(q_kana, 1, 2) AS first FROM long")
def f2_sql(spark, sf):
    """Kana, long vowels and grams through SQL alone."""
    register(spark)
    return spark.sql(
        "SELECT query_id, q_kana, q_long, size(g) AS n_grams, coalesce(get(g, 0), q_kana) AS first FROM (SELECT *, long_vowels(q_kana) AS q_long, grams(q_kana, 2) AS g FROM (SELECT query_id, to_hiragana(q_norm) AS q_kana FROM {asked}))",
        asked=_questions(spark, sf).select("query_id", "q_norm"),
    )


@query("f12_gram_modes", f"SELECT p_partkey, len({TRI.format(t='p_name')})::INTEGER AS gloss, (length(p_name) + length(p_name) - 1 + length(p_name) - 2)::INTEGER AS japanese FROM part")
def f12(spark, sf):
    n = lambda kind: F.size(X.grams_for(F.col("p_name"), F.lit(kind)))
    return _names(spark, sf).select("p_partkey", n("gloss").alias("gloss"), n("kanji").alias("japanese"))


@query("f14_containment", "SELECT doc_id, contains(text, 'the') AS found FROM documents")
def f14(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", F.contains("text", F.lit("the")).alias("found"))


@query("f15_first_readings", W.sql(W.ENTRIES) + " SELECT ent_seq, t AS text, min(i)::INTEGER AS i FROM (SELECT ent_seq, unnest(rebs) AS t, generate_subscripts(rebs, 1) - 1 AS i FROM entries) GROUP BY ent_seq, t")
def f15(spark, sf):
    return W.entries(spark, sf).select("ent_seq", F.inline(X.first_readings(F.col("r_ele.reb"))))


@query("f16_split_reference", W.sql(W.REFERENCES) + " SELECT ent_seq, kind, string_split(target, '・')[1] AS primary_part, string_split(target, '・')[2] AS secondary_part FROM refs")
def f16(spark, sf):
    part = X.split_reference(F.col("target"))
    return W.references(spark, sf).select("ent_seq", "kind", part["primary"].alias("primary_part"), part["secondary"].alias("secondary_part"))


@query(
    "f17_tokens",
    f"WITH tok(i, label) AS (VALUES {_values(list(enumerate(V.PRIORITIES)))}) SELECT p_partkey, tok.i::INTEGER AS idx, tok.label FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'nf' || lpad(p_size::VARCHAR, 2, '0') ELSE 'none' END AS l FROM part) p LEFT JOIN tok ON tok.label = p.l",
)
def f17(spark, sf):
    label = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("nf"), F.lpad(F.col("p_size").cast("string"), 2, "0"))).otherwise("none")
    idx = V.encode(label, "pri")
    return W.table(spark, sf, "part").select("p_partkey", idx.alias("idx"), V.decode(idx, "pri").alias("label"))


@query(
    "f18_language_codes",
    f"WITH l(iso, code) AS (VALUES {_values([(iso, lang) for lang, isos in V.LANGUAGES.items() for iso in isos.split()])}) SELECT doc_id, coalesce(l.code, 'unk') AS code FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fre' WHEN 'de' THEN 'ger' ELSE 'xyz' END AS iso FROM documents) d LEFT JOIN l USING (iso)",
)
def f18(spark, sf):
    iso = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fre").when(F.col("lang") == "de", "ger").otherwise("xyz")
    return W.table(spark, sf, "documents").select("doc_id", V.language_of(iso).alias("code"))


@query("f19_common", W.sql(W.ENTRIES) + " SELECT ent_seq, (len(pris) > 0 AND pris[1] <> 'oth1')::INTEGER AS common FROM entries")
def f19(spark, sf):
    return W.entries(spark, sf).select("ent_seq", V.is_common(F.flatten(F.col("k_ele.ke_pri"))).alias("common"))


POSTINGS = f"postings AS (SELECT DISTINCT lang, unnest(list_distinct({TRI.format(t='text')})) AS gram, ent_seq, meta1, meta2, length(text) AS len, common FROM lex_terms)"


@query("a1_index_build", W.sql(W.LEX_TERMS, POSTINGS) + " SELECT lang, gram, count(*) AS df FROM postings GROUP BY lang, gram")
def a1(spark, sf):
    return Q.gram_frequencies(Q.build_postings(W.lex_terms(spark, sf)))


@query("a2_index_totals", W.sql(W.LEX_TERMS, POSTINGS) + " SELECT lang, count(DISTINCT gram) AS terms, count(*)::BIGINT AS postings FROM postings GROUP BY lang")
def a2(spark, sf):
    return Q.index_totals(Q.gram_frequencies(Q.build_postings(W.lex_terms(spark, sf))))


HITS = """hits AS (
  SELECT q.query_id, t.ent_seq, 'gloss' AS kind, t.lang, t.meta1, t.meta2, length(t.text)::INTEGER AS len, t.common, q.q_raw,
    (CASE WHEN length(t.text) = length(q.q_raw) THEN 128 ELSE 0 END + (31 - least(31, length(t.text) - length(q.q_raw))) * 2 + t.common)::INTEGER AS score
  FROM lex_terms t JOIN lex_queries q ON contains(t.text, q.q_raw))"""
SEARCH = W.sql(W.LEX_TERMS, W.LEX_QUERIES, HITS)


def _hits(spark, sf):
    terms, queries = W.lex_terms(spark, sf), Q.rewrite_queries(W.lex_queries(spark, sf))
    return Q.search(terms, queries)


@query("k1_k2_k3_scored_hits", SEARCH + " SELECT query_id, ent_seq, meta1, meta2, len, score FROM hits")
def k1(spark, sf):
    return _hits(spark, sf).select("query_id", "ent_seq", "meta1", "meta2", "len", "score")


@query("j3_posting_intersection", SEARCH + f", qg AS (SELECT query_id, unnest(list_distinct({TRI.format(t='q_raw')})) AS gram FROM lex_queries), p AS (SELECT ent_seq, meta1, meta2, lang, unnest(list_distinct({TRI.format(t='text')})) AS gram FROM lex_terms), n AS (SELECT query_id, count(*) AS n FROM qg GROUP BY query_id), m AS (SELECT query_id, lang, ent_seq, meta1, meta2, count(*) AS met FROM qg JOIN p USING (gram) GROUP BY ALL) SELECT query_id, lang, ent_seq, meta1, meta2 FROM m JOIN n USING (query_id) WHERE met = n")
def j3(spark, sf):
    grams = Q.query_grams(Q.rewrite_queries(W.lex_queries(spark, sf)))
    return Q.intersect_lists(Q.gram_lists(W.lex_terms(spark, sf), only=Q.few(grams)), grams)


BEST = "best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, ent_seq ORDER BY score DESC, meta1, meta2) = 1)"
PAGED = "paged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ent_seq, meta1, meta2) AS rn FROM best)"


@query("u2_distinct_entries", SEARCH + ", " + BEST + " SELECT query_id, ent_seq, meta1, score FROM best")
def u2(spark, sf):
    return Q.best_per_entry(_hits(spark, sf)).select("query_id", "ent_seq", "meta1", "score")


@query("k4_top_k_page", SEARCH + ", " + BEST + ", " + PAGED + " SELECT query_id, rn::INTEGER AS place, ent_seq, meta1, score, 0 AS page FROM paged WHERE rn <= 10")
def k4(spark, sf):
    """The flagship: index build, query rewrite, candidates, verification, score and top page for a whole table of queries."""
    terms, queries = W.lex_terms(spark, sf), Q.rewrite_queries(W.lex_queries(spark, sf))
    return Q.pages(Q.best_entries(terms, queries, 10), 10, 0, 0).select("query_id", "place", "ent_seq", "meta1", "score", "page")


@query("k4_stored_index", SEARCH + ", " + BEST + ", " + PAGED + " SELECT query_id, rn::INTEGER AS place, ent_seq, meta1, score FROM paged WHERE rn <= 10")
def k4_stored(spark, sf):
    """The same page from an index that is written first: of the stored postings only the buckets of the queries' grams are read."""
    terms, queries = W.lex_terms(spark, sf), Q.rewrite_queries(W.lex_queries(spark, sf))
    at = fresh_path(spark, "index")
    T.write_index(terms, at)
    stored = T.read_postings(spark, at, Q.query_grams(queries))
    return Q.pages(Q.best_entries(terms, queries, 10, stored), 10, 0, 0).select("query_id", "place", "ent_seq", "meta1", "score")


@query("k4_later_pages", SEARCH + ", " + BEST + ", " + PAGED + " SELECT query_id, rn::INTEGER AS place, ent_seq, ((rn - 1) // 10)::INTEGER AS page FROM paged WHERE rn > 10 AND rn <= 40")
def k4_later(spark, sf):
    return Q.pages(Q.best_per_entry(_hits(spark, sf)), 10, 1, 3).select("query_id", "place", "ent_seq", "page")


@query("k5_result_cap", SEARCH + " SELECT query_id, ent_seq, meta1, score FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ent_seq, meta1, meta2) <= 20000")
def k5(spark, sf):
    return Q.cap(_hits(spark, sf)).select("query_id", "ent_seq", "meta1", "score")


@query("k6_page_bounds", "SELECT p_partkey, CASE WHEN p_size * 4 - 20 BETWEEN 1 AND 128 THEN p_size * 4 - 20 ELSE 16 END AS size FROM part")
def k6(spark, sf):
    return W.table(spark, sf, "part").select("p_partkey", Q.page_size(F.col("p_size") * 4 - 20).alias("size"))


@query("j4_enriched_hits", SEARCH + ", " + BEST + ", " + PAGED + " SELECT query_id, ent_seq, score, d.source, d.n_chars FROM paged JOIN documents d ON d.doc_id = ent_seq WHERE rn <= 16")
def j4(spark, sf):
    entries = W.table(spark, sf, "documents").select(F.col("doc_id").alias("ent_seq"), "source", "n_chars")
    return Q.enrich(Q.pages(Q.best_per_entry(_hits(spark, sf)), None, 0, 0), entries).select("query_id", "ent_seq", "score", "source", "n_chars")


@query("u1_hit_sources", SEARCH + " SELECT query_id, lang, count(*) AS n, count(DISTINCT ent_seq) AS entries FROM hits GROUP BY query_id, lang")
def u1(spark, sf):
    return _hits(spark, sf).groupBy("query_id", "lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ent_seq").alias("entries"))


#: Names in katakana and questions in hiragana, letter by letter, with letters that make no long vowels.
KATA = "カキクケコサシスセソタチツテトナニヌネノハヒフヘホマ"
HIRA = "".join(chr(ord(c) - 0x60) for c in KATA)
JAPANESE = f"""jterms AS (SELECT p_partkey AS ent_seq, translate(lower(p_name), '{LOW}', '{KATA}') AS text, 'jp' AS side, (p_size % 2)::INTEGER AS common FROM part
  UNION ALL SELECT p_partkey, lower(p_type), 'gloss', (p_size % 2)::INTEGER FROM part),
jqueries AS (SELECT p_partkey AS query_id, string_split(p_name, ' ')[1] AS word, p_partkey % 2 = 0 AS jp FROM part WHERE p_size = 7),
jasked AS (SELECT query_id, CASE WHEN jp THEN translate(lower(word), '{LOW}', '{HIRA}') ELSE lower(string_split(t.p_type, ' ')[1]) END AS q, CASE WHEN jp THEN 'jp' ELSE 'gloss' END AS side FROM jqueries JOIN part t ON t.p_partkey = query_id),
jhits AS (SELECT query_id, ent_seq, a.side, length(text)::INTEGER AS len, (CASE WHEN length(text) = length(q) THEN 128 ELSE 0 END + CASE WHEN a.side = 'jp' THEN 64 ELSE 0 END + (31 - least(31, length(text) - length(q))) * 2 + common)::INTEGER AS score
  FROM jasked a JOIN jterms t ON t.side = a.side AND contains(translate(text, '{X.KATAKANA}', '{X.HIRAGANA}'), q))"""


@query("u1_japanese_sources", W.sql(JAPANESE) + " SELECT query_id, ent_seq, side, len, score FROM jhits")
def u1_japanese(spark, sf):
    """Questions in kana against names in the other kana, and Latin ones against glosses, in one search."""
    p = W.table(spark, sf, "part")
    common = (F.col("p_size") % 2).cast("int").alias("common")
    kana = lambda c, to: F.translate(F.lower(c), LOW, to)
    zero = [F.lit(0).alias("meta1"), F.lit(0).alias("meta2")]
    names = p.select(F.col("p_partkey").alias("ent_seq"), kana(F.col("p_name"), KATA).alias("text"), *zero, F.lit("reading").alias("kind"), F.lit("jp").alias("lang"), common)
    names = names.withColumn("text", X.fold_kana(F.col("text")))  # an index of forms is folded
    glosses = p.select(F.col("p_partkey").alias("ent_seq"), F.lower("p_type").alias("text"), *zero, F.lit("gloss").alias("kind"), F.lit("en").alias("lang"), common)
    word = F.when(F.col("p_partkey") % 2 == 0, kana(F.element_at(F.split("p_name", " "), 1), HIRA)).otherwise(F.lower(F.element_at(F.split("p_type", " "), 1)))
    queries = Q.rewrite_queries(p.where("p_size = 7").select(F.col("p_partkey").alias("query_id"), word.alias("q_raw")))
    hits = Q.search(names.unionByName(glosses), queries)
    return hits.select("query_id", "ent_seq", F.when(F.col("kind") == "gloss", "gloss").otherwise("jp").alias("side"), "len", "score")


@query("u5_active_languages", "SELECT DISTINCT lang FROM documents WHERE lang IN ('en', 'es', 'fr', 'de', 'hu', 'nl', 'ru', 'slv', 'sv') AND text <> ''")
def u5(spark, sf):
    return Q.active_languages(V.languages(spark).select("lang"), Q.build_postings(W.lex_terms(spark, sf)))
