"""Exact deduplication, mixing, URL filters and components."""

import random
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import exact_dedup, mixing, url_filter
from lexiflow.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_components_against_union_find(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2400)] + [(7000, 7000)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame([*edges, (None, 1)], "src long, dst long")).collect()
    assert {(x.node, x.component) for x in got} == {(x, root(x)) for x in parent}
    assert len(got) == len(parent)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


ROWS = [(5, "a b", "x"), (3, "a \t\n b", "x"), (9, None, "y"), (2, "", "y"), (7, "a b", None), (7, "a b", None), (8, "z" * 50_000, "x"), (None, "q", "x"), (None, "q", "x"), (1, " ", "x")]


@pytest.mark.parametrize("support", [0.001, 0.3])
def test_exact_dedup_cases(spark, support):
    d = docs(spark, ROWS).withColumn("digest", F.lit("mine")).withColumn("kept", F.lit(1)).withColumn("xd_rank", F.lit(2))
    rows = exact_dedup.annotate(d, support=support).collect()
    assert len(rows) == len(ROWS)
    by = {(r.doc_id, r.keep_id, r.group_size): r.kept for r in rows if r.doc_id is not None}
    assert by == {(5, 3, 4): False, (3, 3, 4): True, (7, 3, 4): False, (9, 2, 2): False, (2, 2, 2): True, (8, 8, 1): True, (1, 1, 1): True}
    assert Counter((r.keep_id, r.kept) for r in rows if r.doc_id is None) == {(None, True): 1, (None, False): 1}
    kept = exact_dedup.keep_first(d, support=support)
    assert kept.columns == d.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 8]


def test_exact_dedup_heavy_equals_plain(spark):
    r = random.Random(1)
    d = docs(spark, [(i, "copy" if i % 3 == 0 else f"t{r.randint(0, 400)}", "s") for i in range(1500)])
    sets = [{tuple(x) for x in exact_dedup.annotate(d, support=s).collect()} for s in (0.001, 0.05, 0.9)]
    assert sets[0] == sets[1] == sets[2]
    assert exact_dedup.annotate(d.where("false")).count() == 0 == exact_dedup.keep_first(d.where("false")).count()


def test_mix_means_and_order(spark):
    d = docs(spark, [(i, f"t{i}", "big" if i < 4000 else "small" if i < 4500 else None) for i in range(5000)])
    mixed = mixing.mix(d, rows=6000)
    got = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    total = sum(n**mixing.TEMPERATURE for n in (4000, 500, 500))
    for source, n in (("big", 4000), ("small", 500), (None, 500)):
        want = 6000 * n**mixing.TEMPERATURE / total
        assert abs(got[source] - want) < 5 * want**0.5
    counts = Counter(r["count"] for r in mixed.where("source = 'small'").groupBy("doc_id").count().collect())
    assert len(counts) > 4  # Poisson, not a constant
    ids = [r.doc_id for r in mixed.where("source = 'big'").limit(500).collect()]
    assert ids != sorted(ids)


def test_mix_weights_and_cases(spark):
    d = docs(spark, [(1, None, "a"), (1, None, "a"), (None, "x", "a"), (2, "", "b"), (3, "y", None)]).withColumn("mix_n", F.lit(9)).withColumn("copy", F.lit("mine"))
    mixed = mixing.mix(d, {"a": 1.0}, rows=300)
    assert {r.source for r in mixed.collect()} == {"a"} and "mix_n" in mixed.columns
    same = Counter(r.copy for r in mixed.where("doc_id = 1").collect())
    assert set(same.values()) == {2}
    assert mixing.mix(d.where("false")).count() == 0
    assert mixing.mix(d, {"nope": 1.0}).count() == 0


def test_mix_high_rates(spark):
    d = docs(spark, [(i, "t", "a") for i in range(40)])
    n = mixing.mix(d, rows=40 * 900).count()
    assert abs(n - 36_000) < 5 * 36_000**0.5


PAGES = [
    (0, "https://x.com/en/1", None), (1, "http://www.x.com/en/1/#top", None), (2, "https://example.com/en/7?x=1", None), (3, "http://a.example.net/de/81", ""), (4, "http://b.net/de/8", ""),
    (5, "https://free.org/fr/1", '<link rel="canonical" href="https://c.org/es/5">'), (6, None, "x"), (7, "no scheme", None), (8, "HTTP://A.ORG/ES/1", None), (9, "https://A.Org/es/", None),
    (10, "http://plain.org/a", None), (10, "http://plain.org/a", None), (11, "://", ""), (12, "http://q.org/1?utm_source=a", ""), (13, "https://comx/en/1", ""), (14, "http://r.org/x", '<META http-equiv=refresh content="0; url=/es/9">'),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("own", F.lit(1))


def test_url_rules(spark):
    rows = url_filter.filter_urls(pages(spark)).collect()
    assert len(rows) == len(PAGES)
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in rows}
    assert got[0] == ("x.com", "com/en/", "block") and got[1] == ("www.x.com", "com/en/", "block")
    assert got[2] == ("example.com", "example.com/en/7", "allow")
    assert got[3] == ("a.example.net", "example.net/de/8", "block") and got[4] == ("b.net", "net/de/", "allow")
    assert got[5] == ("free.org", None, "block")  # its canonical page is blocked
    assert got[6] == ("", None, "allow") == got[7]
    assert got[8] == ("a.org", None, "allow") and got[9] == ("a.org", "org/es/", "block")
    assert got[11] == ("", None, "allow") and got[13] == ("comx", None, "allow")
    assert got[14] == ("r.org", None, "block")


def test_url_allow_precedence_and_redirects(spark):
    p = spark.createDataFrame([(1, "http://u.org/1", None), (2, "http://v.org/1", None), (3, "http://w.org/1", None)], "page_id long, url string, html string")
    links = spark.createDataFrame([("http://u.org/1", "http://t.com/en/1"), ("http://v.org/1", "http://t.com/en/2"), ("http://v.org/1", "http://example.com/en/7"), (None, "x")], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(p, redirects=links).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}
    assert url_filter.filter_urls(p.where("false")).count() == 0


def test_links_are_resolved(spark):
    rows = [
        ("http://a.org/x/page.html", "other.html", "http://a.org/x/other.html"), ("http://a.org/x/page.html", "?id=3", "http://a.org/x/page.html?id=3"), ("https://a.org/x", "//b.com/y", "https://b.com/y"),
        ("http://a.org", "z", "http://a.org/z"), ("http://a.org/x/", "/q", "http://a.org/q"), ("http://a.org/x", "#top", None), ("http://a.org/x", "mailto:me", None), ("http://a.org/x", "http://c.net/", "http://c.net/"), ("http://a.org/x", "", None),
    ]
    d = spark.createDataFrame([(a, b) for a, b, _ in rows], "url string, target string").select(url_filter.resolved(F.col("target"), F.col("url")).alias("r"))
    assert [r.r for r in d.collect()] == [c for _, _, c in rows]


def test_both_links_of_a_page_count(spark):
    html = '<link rel="canonical" href="http://plain.org/a"><meta http-equiv="refresh" content="0; url=http://s.com/en/1">'
    p = spark.createDataFrame([(1, "http://free.net/1", html), (2, "http://long.org/" + "a" * 200_000, html.replace("plain.org/a", "own.org/b"))], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(p).collect()} == {1: "block", 2: "block"}


def test_rules_as_a_table(spark):
    table = spark.createDataFrame([(r.verdict, r.text) for r in url_filter.RULES] + [(None, "x/"), ("block", None)], "verdict string, text string")
    few, many = (sorted(map(str, url_filter.filter_urls(pages(spark), rules).collect())) for rules in (url_filter.RULES, table))
    assert few == many
    assert {r.verdict for r in url_filter.filter_urls(pages(spark), table.where("false")).collect()} == {"allow"}


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op4_source_mix", "op10_url_filter"])
def test_sql(spark, name):
    from lexiflow.llm import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    want = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in df.select(cols).collect()))) == sorted(map(str, want.fetchall()))


def test_very_long_urls_take_linear_time(spark):
    """A megabyte of slashes, with and without a letter behind, a long path before a relative link, many labels, many parameters."""
    n = 1_000_000
    urls = ["http://a.com/" + "/" * n, "http://a.com" + "/" * n + "x", "http://a.com/" + "x" * n, "http://a.com/" + "x/" * (n // 2), "http://" + "a." * (n // 2) + "com/en/1", "http://a.com/?" + "a=1&" * (n // 4), "x" * n]
    html = '<link rel="canonical" href="next">'
    pages = spark.createDataFrame([(k, u, html) for k, u in enumerate(urls)], "page_id long, url string, html string")
    url_filter.filter_urls(pages.limit(1)).collect()
    began = time.monotonic()
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    took = time.monotonic() - began
    assert got[4].rule == "com/en/" and got[4].verdict == "block" and got[0].verdict == "allow" and len(got) == len(urls)
    columns = [url_filter.canonical(F.col("url")), url_filter.canonical(url_filter.resolved(F.lit("next"), F.col("url"))), url_filter.rule_for(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))]
    for k in range(len(urls)):
        one = pages.where(F.col("page_id") == k).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
        began = time.monotonic()
        one.write.format("noop").mode("overwrite").save()
        assert time.monotonic() - began < 3, k  # a start of a job is in it
    assert took < 60


def test_canonical_and_resolved_paths(spark):
    cases = [("http://a.com///", "http://a.com"), ("http://a.com/b//", "http://a.com/b"), ("http://a.com", "http://a.com"), ("http://a.com/b/c", "http://a.com/b/c"), ("http://www.a.com/?b=1&a=2", "http://a.com?a=2&b=1")]
    got = spark.createDataFrame([(u,) for u, _ in cases], "u string").select(url_filter.canonical(F.col("u"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]
    cases = [("http://a.com/b/c", "http://a.com/b/x"), ("http://a.com/b/", "http://a.com/b/x"), ("http://a.com", "http://a.com/x"), ("http://a.com/ü/é?q#f", "http://a.com/ü/x"), ("http://a.com/b", "http://a.com/x")]
    got = spark.createDataFrame([(u,) for u, _ in cases], "u string").select(url_filter.resolved(F.lit("x"), F.col("u"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_quantile_is_a_count(spark):
    rng = random.Random(1)
    rows = [(sorted(rng.choice([0.0, 0.25, 0.5, rng.random(), 1.0]) for _ in range(rng.randrange(1, 70))), rng.choice([0.0, 0.25, 0.5, rng.random()])) for _ in range(400)]
    got = spark.createDataFrame(rows, "cdf array<double>, u double").select(mixing.quantile(F.col("cdf"), F.col("u"))).collect()
    assert [r[0] for r in got] == [sum(c <= u for c in cdf) for cdf, u in rows]
