"""URL filters by redirect equivalence (native).

URLs that redirect to each other, name one another as canonical or differ only in what does not select a page (scheme,
fragment, tracking parameters, a final slash, ``www.`` and ``m.`` hosts) are aliases. Edges between aliases are joined into
components; a block rule that hits any member holds for all members without a rule, unless a member is explicitly allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, staged
from .components import connected_components


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path prefix in one, like ``example.com/en/``; ``verdict`` is ``allow`` or ``block``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The production rules.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes_of(host: Column, most: int) -> Column:
    """The last 1 to ``most`` labels of a host, each as a host; no rule has more labels."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.call_function("substring_index", host, F.lit("."), -i)))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null.

    The rules sit in one map from host to its rules; a URL looks up each suffix of its host, so the cost depends on
    the labels of the host and not on the number of rules. At equal length allow goes before block, then by text.
    """
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    if not by_host:
        return F.lit(None).cast("struct<n:int,verdict:string,rule:string>")
    as_struct = lambda r: F.struct(F.lit(-len(r.text)).alias("n"), F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"), F.lit(r.path).alias("path"))
    table = F.create_map(*[x for h, rs in sorted(by_host.items()) for x in (F.lit(h), F.array(*map(as_struct, rs)))])
    suffixes = suffixes_of(host, max(h.count(".") for h in by_host) + 1)
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    best = F.array_min(F.filter(found, lambda r: F.startswith(path, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["n"].alias("n"), best["verdict"].alias("verdict"), best["rule"].alias("rule")))


def canonical(url: Column) -> Column:
    """One spelling for URLs that name the same page; null for null and for what has no ``://``."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_\w+|ref|fbclid|gclid)(=|$)")))
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    return F.when(
        F.contains(url, F.lit("://")),
        F.concat(F.lit("http://"), host, F.rtrim(path_of(url), F.lit("/")), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")),
    )


def resolved(to: Column, url: Column) -> Column:
    """Where a link in the page at ``url`` leads: absolute, beginning with ``//``, at the host, a query, or beside the page; null for places in the page
    and for schemes without ``://``."""
    root, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)))
    beside = F.when(path == "", F.lit("/")).otherwise(folder)
    return (
        F.when(to == "", None).when(F.contains(to, F.lit("://")), to)
        .when(F.startswith(to, F.lit("//")), F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(root, to)).when(F.startswith(to, F.lit("?")), F.concat(root, path, to))
        .when(F.startswith(to, F.lit("#")) | to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).otherwise(F.concat(root, beside, to))
    )


def canonical_link(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)


def refresh_link(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)""", 1)


def rules_by_url(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, own): for a table of rules (verdict, text) of any size, the struct of :func:`rule_for` for each url that a rule fits.

    Each url asks for the suffixes of its host, a few rows, in a join that Spark broadcasts only while the rules are small; the longest is kept by a maximum that
    is combined before the shuffle.
    """
    most = rules.agg(F.max(F.size(F.split(F.substring_index("text", "/", 1), r"\.")))).first()[0] or 1
    suffixes = suffixes_of(F.col("host"), most)
    asked = urls.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    asked = asked.select("url", "path", F.explode(suffixes).alias("rule_host"))
    table = rules.where("text is not null and verdict is not null").select(
        F.substring_index("text", "/", 1).alias("rule_host"), F.concat(F.lit("/"), F.regexp_extract("text", r"(?s)^[^/]*/(.*)$", 1)).alias("rule_path"), (-F.length("text")).alias("n"), "verdict", F.col("text").alias("rule")
    )
    fits = asked.join(table, "rule_host").where(F.startswith("path", F.col("rule_path")))
    return fits.groupBy("url").agg(F.min(F.struct("n", "verdict", "rule")).alias("own"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(id, host, path, rule, verdict, alias_verdict) for every row of ``pages``.

    ``rules`` are a few, which become part of the plan, or a table (verdict, text) of any size. ``redirects`` (src, dst) adds edges known from elsewhere; a page's
    canonical link and its refresh are an edge each. A page with a rule of its own keeps the rule's verdict. Else an allowed alias allows it, else
    a blocked alias blocks it, else it is allowed. A null URL, or one without ``://``, has an empty host and path, no rule and no aliases, and is
    allowed. URLs of any length are read whole. Of rules of equal length allow goes first, then the text. Repeated rows and ids are judged row by row; an empty
    table gives an empty result; further columns are not looked at.
    """
    html = F.col(html_col) if html_col else F.lit(None).cast("string")
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    known = F.contains("url", F.lit("://"))
    url = F.col("url")
    edges = pages.where(known).select(F.inline(F.array(
        F.struct(url.alias("src"), canonical(url).alias("dst")),
        F.struct(url.alias("src"), canonical(resolved(canonical_link(F.col("html")), url)).alias("dst")),
        F.struct(url.alias("src"), canonical(resolved(refresh_link(F.col("html")), url)).alias("dst")),
    )))
    if redirects is not None:
        more = redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")).where("src is not null and dst is not null")
        edges = edges.unionByName(more).unionByName(more.select("src", canonical(F.col("src")).alias("dst"))).unionByName(more.select(F.col("dst").alias("src"), canonical(F.col("dst")).alias("dst")))
    member = connected_components(edges)
    out = pages.select("id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    if isinstance(rules, tuple):
        judged = member.withColumn("verdict", rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
        out = out.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    else:
        own = staged(rules_by_url(member.select(F.col("node").alias("url")), rules), "rules")
        judged = member.join(own.select(F.col("url").alias("node"), "own.verdict"), "node")
        out = out.join(own, "url", "left")
    # "allow" < "block", so the minimum over a component gives allow the precedence
    decided = judged.groupBy("component").agg(F.min("verdict").alias("alias_verdict")).where("alias_verdict is not null")
    passed_on = member.join(decided, "component").select(F.col("node").alias("url"), "alias_verdict")
    return out.join(passed_on, "url", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"), "alias_verdict",
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


_HOST = r"translate(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
SQL = r"""
WITH RECURSIVE rules(verdict, rule) AS (VALUES ('block','com/en/'),('allow','example.com/en/7'),('allow','net/de/'),('block','example.net/de/8'),('block','org/es/')),
p AS (SELECT page_id, url, coalesce(HOST, '') AS host, coalesce(PATH, '') AS path,
  regexp_extract(url, '^(?s:[^#]*?)\?([^#]*)', 1) AS query, url LIKE '%://%' AS known,
  coalesce(nullif(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1), ''),
           nullif(regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1), '')) AS link,
  nullif(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1), '') AS refresh FROM pages),
urls AS (SELECT DISTINCT url AS src, url AS u FROM p WHERE known
  UNION SELECT url, CASE WHEN target LIKE '%://%' THEN target WHEN target LIKE '//%' THEN regexp_extract(url, '^((?s:.*?))://', 1) || ':' || target WHEN target LIKE '/%' THEN root || target
    WHEN target LIKE '?%' THEN root || path || target WHEN target LIKE '#%' OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE root || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || target END
  FROM (SELECT url, path, unnest([link, refresh]) AS target, regexp_extract(url, '^(?s:.*?)://[^/?#]*', 0) AS root FROM p WHERE known) WHERE target IS NOT NULL),
cut AS (SELECT src, HOSTU AS host, PATHU AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '^(?s:[^#]*?)\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_\w+|ref|fbclid|gclid)(=|$)'))) AS params FROM urls WHERE u IS NOT NULL),
edge AS (SELECT DISTINCT src, 'http://' || regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || list_aggregate(params, 'string_agg', '&') ELSE '' END AS dst FROM cut),
both_ways AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge UNION SELECT src, src FROM edge UNION SELECT dst, dst FROM edge),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
node AS (SELECT DISTINCT a AS u FROM both_ways),
hp AS (SELECT u, HOSTU AS host, PATHU AS path FROM node),
hit AS (SELECT u, arg_max(r.verdict, length(r.rule)) AS verdict FROM hp JOIN rules r
  ON (host = split_part(r.rule, '/', 1) OR ends_with(host, '.' || split_part(r.rule, '/', 1))) AND starts_with(path, substr(r.rule, strpos(r.rule, '/'))) GROUP BY u),
alias AS (SELECT a AS url, min(verdict) AS alias_verdict FROM reach JOIN hit ON hit.u = reach.b GROUP BY a),
own AS (SELECT page_id, url, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM p JOIN rules r
  ON (host = split_part(r.rule, '/', 1) OR ends_with(host, '.' || split_part(r.rule, '/', 1))) AND starts_with(path, substr(r.rule, strpos(r.rule, '/'))) GROUP BY page_id, url)
SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.verdict, alias.alias_verdict, 'allow') AS verdict, alias.alias_verdict
FROM p LEFT JOIN own ON own.page_id = p.page_id AND own.url = p.url LEFT JOIN alias ON alias.url = p.url
""".replace("HOSTU", _HOST.format(u="u")).replace("PATHU", _PATH.format(u="u")).replace("HOST", _HOST.format(u="url")).replace("PATH", _PATH.format(u="url"))
