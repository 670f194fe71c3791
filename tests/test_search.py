"""Grams by arrays, questions that are asked alike, and intersections by lists."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lexiflow.functions import grams as G
from lexiflow.functions import text as X
from lexiflow.operators import search as Q


def test_grams_by_arrays(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, None if r.random() < 0.1 else "".join(r.choice("abカ😀é\0") for _ in range(r.randint(0, 9))), r.choice(["gloss", "reading", "kanji"])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, t string, kind string").select("i", "t", "kind", X.grams_for(F.coalesce("t", F.lit("")), F.col("kind")).alias("g"))
    want = [sorted(set(x.g)) for x in df.orderBy("i").collect()]
    texts, kinds = pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows])
    only = ["a", "ab", "カa😀", "zzz"]
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(G, "SLICE", size)
        assert [sorted(g) for g in G.distinct_lists(texts, kinds).to_pylist()] == want
    got = [sorted(x.g) for x in df.select("i", G.distinct_grams(F.col("t"), F.col("kind"), only).alias("g")).orderBy("i").collect()]
    assert got == [[g for g in w if g in only] for w in want]


def _terms(spark, texts):
    return spark.createDataFrame([(i, t, 0, 0, "gloss", "en", 0) for i, t in enumerate(texts)], "ent_seq long, text string, meta1 int, meta2 int, kind string, lang string, common int")


def test_equal_questions_are_searched_once(spark):
    terms = _terms(spark, ["a red ring", "red", "blue ring", "rod"])
    raw = spark.createDataFrame([(k, ("red", "Ring", "none")[k % 3]) for k in range(30)], "query_id long, q_raw string")
    queries = Q.rewrite_queries(raw)
    once, members = Q.asked_once(queries)
    assert once.count() == 3 and members.count() == 30
    want = {(k, e) for k in range(30) for e in ((0, 1), (0, 2), ())[k % 3]}
    assert {(r.query_id, r.ent_seq) for r in Q.search(terms, queries).collect()} == want
    assert {(r.query_id, r.ent_seq) for r in Q.search(terms, queries, Q.build_postings(terms)).collect()} == want
    for stored in (None, Q.build_postings(terms)):
        assert {(r.query_id, r.ent_seq) for r in Q.best_entries(terms, queries, 1, stored).collect()} == {(k, (1, 2)[k % 3]) for k in range(30) if k % 3 < 2}


def test_more_grams_than_tasks_are_given(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 1)
    terms = _terms(spark, ["a red ring", "red", "blue ring"])
    queries = Q.rewrite_queries(spark.createDataFrame([(1, "red"), (2, "ring"), (3, "xyz ring")], "query_id long, q_raw string"))
    assert Q.few(Q.query_grams(queries)) is None
    assert {(r.query_id, r.ent_seq) for r in Q.search(terms, queries).collect()} == {(1, 0), (1, 1), (2, 0), (2, 2)}


def test_intersections_by_lists_and_by_postings(spark):
    terms = _terms(spark, ["a red ring", "red", "blue ring", "ring red", "bring"])
    grams = Q.query_grams(Q.rewrite_queries(spark.createDataFrame([(1, "ring"), (2, "red"), (3, "redx"), (4, "re")], "query_id long, q_raw string")))
    want = {(1, 0), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (2, 3)}
    for found in (Q.intersect_lists(Q.gram_lists(terms, only=Q.few(grams)), grams), Q.intersect_all(Q.build_postings(terms), grams)):
        rows = [(r.query_id, r.ent_seq) for r in found.collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_texts_are_not_dealt_for_few_candidates(spark):
    """The first candidates of a query are few, so they go to the texts and not the texts to them; pages are the same in several rounds and in one."""
    terms = _terms(spark, ["red " * (1 + k % 7) + str(k) for k in range(200)] + ["re ed red"[: k % 9] + " edr" for k in range(300)])
    queries = Q.rewrite_queries(spark.createDataFrame([(1, "red"), (2, "edred"), (3, "7"), (4, "none of it")], "query_id long, q_raw string"))
    store = spark._jsparkSession.sharedState().statusStore()
    begin = store.executionsList().size()
    rows = lambda df: sorted(map(str, df.select(*Q.HIT).collect()))
    got = rows(Q.best_entries(terms, queries, 5, Q.build_postings(terms), ahead=1))
    plans = store.executionsList()
    looked = [p for p in (plans.apply(k).physicalPlanDescription() for k in range(begin, plans.size())) if "/looked-" in p and "InsertIntoHadoopFs" in p and "/some-" in p]
    assert len(looked) > 1 and not any("SortMergeJoin" in p.split("Initial Plan")[0] for p in looked)
    assert got == rows(Q.best_entries(terms, queries, 5)) and len(got) == 5
