"""Exact deduplication with a split for heavy hitters (native).

1. A Misra-Gries summary (``DataFrame.freqItems``) over the digests names every digest held by more than
   ``support`` of all rows, and at most ``1 / support`` others.
2. One counted pass verifies them: exact size and least id of each candidate.
3. The verified winners, at most ``1 / support`` rows, are broadcast; their surplus rows leave on the map side.
4. What is left has no heavy digest and goes through an ordinary shuffle by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, documents, fresh, staged

#: Share of all rows above which a digest counts as heavy; also bounds the broadcast to 1 / SUPPORT rows.
SUPPORT = 0.001


def digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), 256)


def heavy_digests(keys: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, w_keep, w_size) of the digests that Misra-Gries proposes and an exact count confirms as repeated."""
    proposed = keys.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    counted = keys.join(F.broadcast(proposed), "digest").groupBy("digest").agg(F.min("id").alias("w_keep"), F.count(F.lit(1)).alias("w_size"))
    return counted.where("w_size > 1")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id is kept. Null text equals empty text. Null ids sort last: they
    are kept only if the whole group has none. Of rows that repeat both id and text exactly one is kept. Texts of any length are read whole, row
    by row, and only their digests are shuffled. An empty table gives an empty result; other columns, whatever their names, are not looked at.
    """
    keys = staged(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), digest(F.col(text_col)).alias("digest")), "digests")
    marked = keys.join(F.broadcast(staged(heavy_digests(keys, support), "heavy")), "digest", "left")
    surplus = F.col("w_size").isNotNull() & ~F.col("id").eqNullSafe(F.col("w_keep"))
    removed = marked.where(surplus).select("id", F.col("w_keep").alias("keep_id"), F.col("w_size").alias("group_size"), F.lit(False).alias("kept"), F.col("digest").alias("text_sha256"))
    group = Window.partitionBy("digest")
    ordered = group.orderBy(F.col("id").asc_nulls_last(), "tie")
    rest = marked.where(~surplus).select(
        "id",
        F.first("id").over(ordered).alias("keep_id"),
        F.coalesce("w_size", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(ordered) == 1).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return removed.unionByName(rest).withColumnRenamed("id", id_col)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that :func:`annotate` keeps, with all their columns and no others, whatever their names.

    So null text equals empty text, null ids come last, and of rows that repeat id and text one stays; of texts of one id that differ in white space only, the one
    of the lesser hash. Surplus copies of heavy digests leave before the shuffle, in which the other rows take their texts along. An empty table gives an empty one.
    """
    d, keep, size, rank = (fresh(docs, x) for x in ("xd_digest", "xd_keep", "xd_size", "xd_rank"))
    keys = staged(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")), "digests")
    heavy = staged(heavy_digests(keys, support), "heavy").select(F.col("digest").alias(d), F.col("w_keep").alias(keep), F.col("w_size").alias(size))
    left = docs.withColumn(d, digest(F.col(text_col))).join(F.broadcast(heavy), d, "left")
    left = left.where(F.col(size).isNull() | F.col(id_col).eqNullSafe(F.col(keep)))
    ordered = Window.partitionBy(d).orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(F.col(text_col)))
    return left.withColumn(rank, F.row_number().over(ordered)).where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(documents(spark, sf_dir).select("doc_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
