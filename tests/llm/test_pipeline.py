"""The pipeline, stage by stage, against plain code over a small table."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiflow.llm import mixing

from .test_text_operators import brute, planted


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = planted(5)
    en = "the house and the dog walk over the green hill "
    docs = [(i, f"{en * 2} {t}", "en", f"s{i % 3}", 1) for i, t in rows] + [(10_001, None, None, None, None), (10_002, "12 34", "en", "s0", 5), (10_003, "", "en", "s0", 0)]
    docs += [(i + 20_000, t and t.replace(" ", "\t"), lang, s, n) for i, t, lang, s, n in docs[:50]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = stage(spark, docs, folder).cache()
        if name != "byte_bpe":
            assert steps[name].columns == docs.columns
            docs = steps[name]
    rows = {n: [r.asDict() for r in s.collect()] for n, s in steps.items()}
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}

    assert {r["doc_id"] for r in rows["language_id"]} == {i for i, t in start.items() if t and re.search("[a-z]", t)}
    first: dict[str, int] = {}
    for r in sorted(rows["language_id"], key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", r["text"]), r["doc_id"])
    assert {r["doc_id"] for r in rows["exact_dedup"]} == set(first.values())
    found = brute([(r["doc_id"], r["text"]) for r in rows["exact_dedup"]])
    assert {r["doc_id"] for r in rows["near_dedup"]} == {c for _, c in found.values()}
    want = mixing.mix(steps["near_dedup"]).groupBy("doc_id").count().collect()
    got = steps["source_mix"].groupBy("doc_id").count().collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, got))
    texts = {r["doc_id"]: r["text"] for r in rows["source_mix"]}
    assert len(rows["byte_bpe"]) == len(rows["source_mix"])
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows["byte_bpe"])


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_and_unusual_rows_pass_all_stages(spark, tmp_path):
    """Columns called like those that stages add, a text of a megabyte, ties, repeated rows and nulls."""
    en = "the house and the dog walk over the green hill and see a bird on the old tree "
    long = " ".join(f"{w}{k}" for k in range(20_000) for w in ("house", "green", "tree")) + " " + en * 9000
    rows = [(1, en * 3, "en", "s", 1), (1, en * 3, "en", "s", 1), (2, long, "en", "s", 2), (3, long + "x", None, None, 2), (4, None, "en", "s", None), (None, en * 5, "en", "t", 3), (5, en * 5, "en", "t", 3)]
    extra = ["score", "Rate", "lang_pred", "a.b", "copy", "order_key", "kept_5", "mix_u", "digest", "component_id", "n_tokens"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(f"mine {c}").alias(c) for c in extra])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path)).cache()
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[c] == f"mine {c}" for r in found for c in extra), name
        docs = out
    assert {len(r.text) for r in found} <= {len(t) for _, t, *_ in rows if t}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(found)
