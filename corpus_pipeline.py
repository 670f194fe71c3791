"""A training corpus from raw documents, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of ``documents``; the last returns digests of the
encoded corpus. Every stage's result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from lexiflow.llm.common import fresh, staged


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; what has no letters, or parses like none of the languages, goes.

    So null and empty texts go. Short and very long texts are judged by the same rate, whole; equal texts fare alike, repeated rows with them. With no
    labelled row to learn from nothing speaks a learned language and nothing stays. Further columns are carried, whatever their names.
    """
    samples = language_id.train(docs)
    # columns called like those of the prediction step aside meanwhile
    aside = [fresh(docs, f"kept_{k}") if c.lower() in language_id.ADDED else c for k, c in enumerate(docs.columns)]
    found = language_id.identify(docs.toDF(*aside), samples)
    return found.where(language_id.accepted()).select(*[F.col(f"`{c}`") for c in aside]).toDF(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that is equal but for white space.

    Null and empty texts are one group. Rows that repeat id and text are one group as well, of which one row stays; a null id comes last. Texts of any length
    are compared by the SHA-256 of the whole; further columns are carried.
    """
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that is linked by similar word shingles.

    Links are found among ids, and the table of other members, far smaller than the corpus, is joined against it.
    Documents without id are in no group and stay. Null and empty texts are linked with nothing and stay. Rows of one id stay or go together, and texts of
    any length count whole. Further columns are carried.
    """
    found = jaccard_join.join_similar(docs)
    others = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "near")
    return docs.join(others, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands as often as it was drawn, in shuffled order.

    A null source is a source; texts, null, empty or long, are not looked at. Rows that repeat an id are drawn alike. Further columns are carried,
    whatever their names.
    """
    mixed = mixing.mix(docs, copy_col=fresh(docs, "copy"), order_col=fresh(docs, "order_key"))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every row.

    Null counts as empty, with no ids and no bytes; texts of any length are encoded whole, row by row, so repeated rows give repeated results.
    """
    return bpe.digests(bpe.encode_decode(docs.select("doc_id", "text"), bpe.production_vocabulary()), "doc_id")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("byte_bpe", encode_stage),
]

#: SQL cannot express the language, similarity and encoding stages; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
