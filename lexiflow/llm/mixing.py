"""Mixing sources to target weights by Poisson replication (native).

The mean number of times a document is repeated follows from its source's target weight. A uniform number seeded by
the document's id is put through the inverse of the Poisson distribution with that mean, the document is exploded by the
result, and the copies are shuffled globally by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, staged

#: Without weights a source's target is its number of rows to this power: 1 keeps the mix, 0 makes all sources equal.
TEMPERATURE = 0.5
SEED = 17


def _hex(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def uniform(id_: Column, seed: int = SEED) -> Column:
    """A number from [0, 1) for each id: the first 52 bits of an MD5."""
    return F.conv(F.substring(_hex(F.lit(seed), id_), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, rows: int | None) -> DataFrame:
    """(source, n, rate, cdf): one row for each source; cdf[k] is the chance of at most k copies at this rate.

    Logarithms keep the terms finite for any rate; the list ends 12 deviations and 30 steps above the mean, where
    the rest is below what 52 bits can tell.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.coalesce(*[F.when(F.col("source") == s, F.lit(float(w))) for s, w in sorted(weights.items())], F.lit(0.0))
    counts = staged(counts.withColumn("w", weight), "sources")
    total = counts.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    target = float(rows if rows is not None else total["n"] or 0)
    rate = F.lit(target) * F.col("w") / F.lit(float(total["w"] or 1.0)) / F.col("n")
    step = lambda s, k: F.struct(
        (s["lp"] + F.when(k == 0, 0.0).otherwise(F.ln(F.col("rate")) - F.ln(k.cast("double")))).alias("lp"),
        (s["sum"] + F.exp(s["lp"] + F.when(k == 0, 0.0).otherwise(F.ln(F.col("rate")) - F.ln(k.cast("double"))))).alias("sum"),
        F.concat(s["cdf"], F.array(s["sum"] + F.exp(s["lp"] + F.when(k == 0, 0.0).otherwise(F.ln(F.col("rate")) - F.ln(k.cast("double")))))).alias("cdf"),
    )
    start = F.struct((-F.col("rate")).alias("lp"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    rates = counts.withColumn("rate", rate).where("rate > 0")
    return staged(rates.select("source", "n", "rate", F.aggregate(F.sequence(F.lit(0), last), start, step, lambda s: s["cdf"]).alias("cdf")), "rates")


def quantile(cdf: Column, u: Column) -> Column:
    """How many entries of the rising list ``cdf`` are at most ``u``, by halving steps, so that a list for a great rate is not looked through."""
    size = F.size(cdf)
    steps = F.sequence(F.ceil(F.log2(size.cast("double"))).cast("int"), F.lit(0))
    on = lambda at, b: at + F.pow(F.lit(2), b).cast("int")
    return F.aggregate(steps, F.lit(0), lambda at, b: F.when((on(at, b) <= size) & (F.get(cdf, on(at, b) - 1) <= u), on(at, b)).otherwise(at))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy", order_col: str = "order_key") -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with ``copy`` (1, 2, ...) and ``order_key``, in the order of a global shuffle.

    ``weights`` gives the share of each source in the mix; a source that it lacks gets none. ``rows`` is the expected size of the mix, as
    many rows as there are by default. A null source is a source of its own under the default weights and has no share under
    given ones. A null id draws like the id ``null``; rows that repeat an id draw alike. Texts are not looked at.
    An empty table gives an empty result. Columns of ``docs`` called like the two new ones, in whatever case, are replaced; texts may be of any length.

    The table of rates is written first, so Spark knows its size and broadcasts it only while it is small.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (copy_col.lower(), order_col.lower())])
    key, cdf, n, u = (fresh(docs, x) for x in ("mix_source", "mix_cdf", "mix_n", "mix_u"))
    rates = source_rates(docs, weights, source_col, rows).select(F.col("source").alias(key), F.col("cdf").alias(cdf))
    # drawn once for each row, below the join
    seeded = docs.withColumn(u, uniform(F.col(id_col), seed))
    drawn = seeded.join(rates, F.col(source_col).eqNullSafe(F.col(key))).withColumn(n, quantile(F.col(cdf), F.col(u)))
    copies = drawn.where(F.col(n) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy_col))
    copies = copies.withColumn(order_col, F.substring(_hex(F.lit(seed), F.col(id_col), F.col(copy_col)), 1, 16))
    return copies.repartition(order_col).sortWithinPartitions(order_col)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


SQL = f"""
WITH s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s)::DOUBLE * w / (SELECT sum(w) FROM s) / n AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r),
p AS (SELECT *, exp(-rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k::DOUBLE) END) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND cdf <= u) AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, copy, substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 16) AS order_key
FROM (SELECT *, unnest(range(1, n + 1))::INTEGER AS copy FROM n)
"""
