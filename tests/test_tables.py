"""Readers and writers."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import cards as C
from lexiflow.sources import tables as T


def test_versions(spark, tmp_path):
    T.append_events(spark.range(3), str(tmp_path / "a"))
    assert T.read_events(spark, str(tmp_path / "a")).count() == 3
    spark.range(1).withColumn("schema_version", F.lit(9)).write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="schema version 9"):
        T.read_versioned(spark, str(tmp_path / "b")).collect()
    spark.range(1).write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="no schema_version"):
        T.read_versioned(spark, str(tmp_path / "c"))


def test_tsv_rules(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# note\n\n1\tone\t2\t3\t3\t1\nx\tbad\n2\n3\tthree\n", encoding="utf-8")
    rows = T.read_terms_tsv(spark, str(tmp_path / "t.tsv")).orderBy("ent_seq").collect()
    assert [(r.ent_seq, r.text, r.meta1, r.meta2, r.common) for r in rows] == [(1, "one", 2, 3, 1), (3, "three", 0, 0, 0)]


def test_custom_decks(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"id": "a", "name": "A", "entSeqs": [3, 1]}, {"id": "", "name": "none", "entSeqs": [9]}]', encoding="utf-8")
    decks = T.read_custom_decks(spark, str(tmp_path / "d.json"))
    assert {(r.deck_id, r.ent_seq) for r in decks.collect()} == {("a", 3), ("a", 1)}
    assert T.custom_decks_json(decks).first().entSeqs == [1, 3]


def test_history_chunks(spark, tmp_path):
    T.append_history(spark.range(2500).coalesce(1), str(tmp_path / "h"))
    files = spark.read.parquet(str(tmp_path / "h")).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in files) == [500, 1000, 1000]


def test_torn_events(spark):
    events = spark.createDataFrame([(1, 1, 1, 1, "review"), (None, 2, 1, 1, "review"), (1, 3, 1, 1, "odd")], "device_id long, seq long, ts long, card_id long, type string")
    good, bad = T.sound_events(events)
    assert (good.count(), bad.count()) == (1, 2)


def test_empty_filter_does_not_restrict(spark):
    cards = spark.createDataFrame([(1,), (2,)], "card_id long")
    none = spark.createDataFrame([], "ent_seq long")
    assert C.restrict(cards, none).count() == 2
    assert C.restrict(cards, spark.createDataFrame([(2,)], "ent_seq long")).count() == 1


def test_posting_buckets_grow_with_the_data(spark, tmp_path):
    """Ten times the rows: as many more buckets, none much above its size; a gram in a third of all postings is split; reads are pruned."""
    asked = spark.createDataFrame([("rare7",), ("hot",), ("none",)], "gram string")
    for n in (400, 4000):
        at = str(tmp_path / str(n))
        rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("rare"), F.col("id") % 50)).alias("gram"), F.lit("en").alias("lang"), F.col("id").alias("ent_seq"), F.lit(0).alias("meta1"), F.lit(0).alias("meta2"))
        T.write_postings(rows, at, rows=40)
        files = [r["count"] for r in spark.read.parquet(f"{at}/postings").groupBy(F.input_file_name()).count().collect()]
        assert sum(files) == n and max(files) <= 40 and len(files) > n / 80
        assert sorted(map(str, T.read_postings(spark, at).select(rows.columns).collect())) == sorted(map(str, rows.collect()))
        found = T.read_postings(spark, at, asked)
        want = rows.where("gram in ('rare7', 'hot')").count()
        assert found.join(asked, "gram", "left_semi").count() == want and found.count() < n
    assert T.read_postings(spark, at, asked.where("gram = 'rare7'")).count() < n / 10


def test_lookups_read_the_blocks_of_their_keys(spark, tmp_path):
    at = str(tmp_path / "l")
    ids = [*range(0, 3000, 3), 100_000, 100_001]
    entries = spark.createDataFrame([(i, f"e{i}") for i in ids], "ent_seq long, head string")
    T.write_lookup(entries, at, rows=10)
    keys = spark.createDataFrame([(3,), (4,), (100_001,), (200_000,), (-5,), (None,)], "ent_seq long")
    found = T.read_lookup(spark, at, keys)
    assert {r.ent_seq: r.head for r in keys.join(found, "ent_seq", "left").collect()} == {3: "e3", 4: None, 100_001: "e100001", 200_000: None, -5: None, None: None}
    assert found.count() < 500
    T.write_lookup(entries.where("false"), at)
    assert T.read_lookup(spark, at, keys).count() == 0


def test_pages_of_a_learner_with_most_rows(spark):
    from lexiflow.operators import library

    rows = spark.range(500).select(F.when(F.col("id") % 5 != 0, 1).when(F.col("id") % 10 != 0, 2).cast("long").alias("learner_id"), (F.col("id") * 37 % 501).alias("ent_seq"))
    got: dict = {}
    for r in library.paged(rows, 7).collect():
        got.setdefault(r.learner_id, []).append((r.ent_seq, r.page))
    assert {k: len(v) for k, v in got.items()} == {1: 400, 2: 50, None: 50}
    assert all([p for _, p in sorted(v)] == [i // 7 for i in range(len(v))] for v in got.values())


def test_terms_are_written_without_a_sort(spark, tmp_path):
    terms = spark.range(300).select(F.concat(F.lit("l"), F.col("id") % 5).alias("lang"), F.col("id").alias("ent_seq"), F.lit("text").alias("text"), F.lit(0).alias("meta1"), F.lit(0).alias("meta2"), F.lit(1).alias("common"))
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    T.write_terms(terms, str(tmp_path / "t"))
    store = spark._jsparkSession.sharedState().statusStore()
    plans = store.executionsList()
    assert "Sort" not in plans.apply(plans.size() - 1).physicalPlanDescription()
    assert spark.conf.get(name) == before
    assert sorted(map(tuple, T.read_versioned(spark, str(tmp_path / "t")).select("lang", "ent_seq").collect())) == sorted((f"l{i % 5}", i) for i in range(300))


def test_folders_of_an_index_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "MOST_BUCKETS", 8)
    rows = spark.range(2000).select(F.concat(F.lit("g"), F.col("id") % 200).alias("gram"), F.lit("en").alias("lang"), F.col("id").alias("ent_seq"), F.lit(0).alias("meta1"), F.lit(0).alias("meta2"))
    at = str(tmp_path / "i")
    T.write_postings(rows, at, rows=10)
    assert T._shaped(spark, at, "postings").select("lang", "bucket").distinct().count() <= 8
    assert sorted(map(tuple, T.read_postings(spark, at).select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert T.read_postings(spark, at, rows.where("gram = 'g7'")).where("gram = 'g7'").count() == 10
    T.write_postings(rows.where("false"), str(tmp_path / "none"))
    assert T.read_postings(spark, str(tmp_path / "none"), rows).count() == 0


def test_an_index_is_dealt_a_share_at_a_time(spark, tmp_path, monkeypatch):
    """Several shares give the index that one gives; a share is dealt alone, and its shuffle files go before the next."""
    from lexiflow.operators import search as Q

    monkeypatch.setattr(T, "SHARE", 900)
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shuffled = lambda: {f for d in dirs for f in Path(str(d)).rglob("shuffle_*.data")}
    terms = spark.range(400).select(
        F.col("id").alias("ent_seq"), F.concat_ws(" ", F.lit("the"), F.col("id"), F.lit("words")).alias("text"), F.lit(0).alias("meta1"), F.lit(0).alias("meta2"), F.lit("gloss").alias("kind"),
        F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"), F.lit(1).alias("common"),
    )
    want = sorted(map(tuple, Q.build_postings(terms).select("lang", "gram", "ent_seq", "kind", "len", "common").collect()))
    before = shuffled()
    dealt, share = [], T._share
    monkeypatch.setattr(T, "_share", lambda df, k, n: dealt.append((k, n)) or share(df, k, n))
    T.write_index(terms, str(tmp_path / "terms"), rows=500)
    T.write_postings(Q.build_postings(terms), str(tmp_path / "postings"), rows=500)
    n = -(-len(want) // 900)
    assert n > 4 and dealt == 2 * [(k, n) for k in range(n)]
    assert len(shuffled() - before) <= 8  # of the counts that reach the driver; each share of each index had four files more
    for name in ("terms", "postings"):
        assert sorted(map(tuple, T.read_postings(spark, str(tmp_path / name)).select("lang", "gram", "ent_seq", "kind", "len", "common").collect())) == want
        found = T.read_postings(spark, str(tmp_path / name), spark.createDataFrame([("the",), ("39 ",)], "gram string"))
        assert found.where("gram = 'the'").count() == 400 and found.count() < len(want)


def test_blocks_hold_the_rows_that_are_put_in(spark, monkeypatch):
    """Japanese and other forms, texts that are null or empty, numbers of any size or null, grams in several parts; whatever the size of what is packed at once."""
    from lexiflow.functions import blocks as B
    from lexiflow.operators import search as Q

    r = random.Random(5)
    rows = [
        (r.randint(0, 9) + 10**12 * (i % 2), None if i % 50 == 0 else "".join(r.choice("abかな") for _ in range(r.randint(0, 40))), r.choice([0, 3, -7, 70_000, None]), r.choice([-(2**31), 2**31 - 1]), r.choice(["gloss", "reading", None]),
         r.choice(["en", "de", None]), i % 2)
        for i in range(300)
    ]
    terms = spark.createDataFrame(rows, "ent_seq long, text string, meta1 int, meta2 int, kind string, lang string, common int").coalesce(2)
    postings = Q.build_postings(terms)
    want = sorted(map(str, postings.collect()))
    numbers = ["ent_seq", "meta1", "meta2", "len", "common"]
    for size in (50, 1 << 20):
        monkeypatch.setattr(B, "ROWS", size)
        for hot in ({}, {("en", "aba"): 3, (None, "ab"): 2}):
            blocks = B.posting_blocks(terms.withColumn("len", F.length("text")), numbers, hot)
            assert sorted(map(str, B.unpack(blocks, postings.schema).select(postings.columns).collect())) == want
            parts = blocks.where("part > 0").select("lang", "gram").distinct().collect()
            assert {(x.lang, x.gram) for x in parts} == set(hot)
            assert blocks.agg(F.sum("_n")).first()[0] == len(want)
