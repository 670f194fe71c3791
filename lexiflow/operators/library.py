"""The study library: both decks of an entry in one row, search, filters, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .cards import passes
from .lexicon import numbered
from .replay import FIELDS


def two_decks(cards: DataFrame) -> DataFrame:
    """(learner_id, ent_seq, recog struct, recall struct): a full outer join by entry."""
    side = lambda d: cards.where(F.col("deck") == d).select("learner_id", F.col("card_id").alias("ent_seq"), F.struct(*FIELDS).alias(d))
    return side("recog").join(side("recall"), ["learner_id", "ent_seq"], "full")


def with_entries(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of entries that exist."""
    return rows.join(entries, "ent_seq")


def search_library(rows: DataFrame, variants: Column, hits: DataFrame | None, query: str) -> DataFrame:
    """Rows whose entry is among the hits or one of whose texts holds the query without regard to kana script."""
    inside = F.exists(variants, lambda v: F.contains(X.fold_kana(v), X.fold_kana(F.lit(query))))
    if hits is None:
        return rows.where(inside)
    found = hits.select("ent_seq").distinct().withColumn("found", F.lit(True))
    return rows.join(found, "ent_seq", "left").where(F.coalesce("found", F.lit(False)) | inside).drop("found")


def filtered(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(passes(name, F.col("recog.state"), F.col("recall.state")))


def paged(rows: DataFrame, size: int = 20) -> DataFrame:
    """``page`` of each row within its learner, by entry.

    Rows are numbered over all learners in even ranges, and a learner's first number is subtracted, so a learner with very many rows is dealt over many tasks.
    """
    put = numbered(rows, ["learner_id", "ent_seq"], "_at")
    first = put.groupBy(F.col("learner_id").alias("_of")).agg(F.min("_at").alias("_first"))
    found = put.join(first, F.col("learner_id").eqNullSafe(F.col("_of")))
    return found.select(*rows.columns, F.floor((F.col("_at") - F.col("_first")) / size).cast("int").alias("page"))
