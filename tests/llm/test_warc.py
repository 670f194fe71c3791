"""Archives: round trips, the index against a scan, coalesced reads, and unusual pages."""

import gzip
import hashlib
import io
import random

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import warc as W

BIG = "<p>großer Text</p>" * 150_000
ROWS = [
    (7, "http://a.example/7", "x" * 100), (3, "http://a.example/3", "x" * 100), (9, None, "x" * 100), (None, "http://a.example/n", "x" * 100), (4, "http://a.example/4", "x" * 99), (5, "http://a.example/5", "x" * 99),
    (6, "http://a b.example/\r\nWARC-Type: revisit", None), (8, "", ""), (10, "http://a.example/%20", BIG), (11, "http://a.example/11", BIG), (12, "http://a.example/w", "WARC/1.1\r\n\r\n" * 20 + "\r\n\r\nWARC/1.1\r\n"), (12, "http://a.example/w", "WARC/1.1\r\n\r\n" * 20 + "\r\n\r\nWARC/1.1\r\n"), (13, "http://a.example/ü", "\u0000é𝄞" * 60),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("archive", F.lit("mine")).withColumn("payload", F.lit(1))


def test_round_trip(spark, pages, tmp_path):
    index = W.write_archives(pages, str(tmp_path / "w"), archive=3000)
    assert index.count() == len(ROWS) and index.select("archive").distinct().count() > 1
    got = W.read_records(index, run_bytes=4096, share=500).collect()
    assert all(r.sound for r in got) and len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    for i, url, html in ROWS:
        for r in by[f"urn:page:{'' if i is None else i}"]:
            payload = (html or "").encode()
            assert r.payload_digest == hashlib.sha256(payload).hexdigest() and r.payload_bytes == len(payload)
            assert r.record_type == ("revisit" if i in (7, 9, None, 11) else "response")
            assert r.refers_to == {7: "urn:page:3", 9: "urn:page:3", None: "urn:page:3", 11: "urn:page:10"}.get(i)
            assert (bytes(r.payload) == payload) if r.record_type == "response" else r.payload is None
    assert by["urn:page:9"][0].url is None and by["urn:page:8"][0].url == "" and by["urn:page:13"][0].url == "http://a.example/ü"
    assert by["urn:page:6"][0].url == "http://a%20b.example/%0D%0AWARC-Type:%20revisit" and by["urn:page:10"][0].url == "http://a.example/%20"
    whole = {r.record_id: (r.payload_bytes, r.payload_digest) for r in W.resolved(W.read_records(index, payloads=False)).collect()}
    assert whole["urn:page:11"] == (len(BIG.encode()), hashlib.sha256(BIG.encode()).hexdigest())


def test_index_equals_a_scan(spark, pages, tmp_path):
    index = W.write_archives(pages, str(tmp_path / "w"), archive=3000)
    scanned = W.index_archives(index.select(F.col("archive").alias("path")).unionByName(spark.createDataFrame([(None,)], "path string")))
    cols = [c for c in index.columns if c != "url"]  # the table has the URL as it was, the record as it can be written
    assert sorted(map(str, scanned.select(cols).collect())) == sorted(map(str, index.select(cols).collect()))


def test_archives_are_gzip_and_plain_ones_are_read(spark, pages, tmp_path):
    index = W.write_archives(pages, str(tmp_path / "w"))
    name = index.where("record_id = 'urn:page:13'").first().archive
    raw = gzip.decompress(open(name, "rb").read())
    (tmp_path / "plain.warc").write_bytes(raw)
    found = [W.parse_record(x) for _, _, x in W.members(io.BytesIO(raw), piece=7)]
    assert [W.parse_record(x) for _, _, x in W.members(open(name, "rb"))] == found and found
    plain = W.index_archives(spark.createDataFrame([(str(tmp_path / "plain.warc"),)], "path string"))
    assert plain.count() == len(found)
    assert sorted(r.payload_digest for r in W.read_records(plain).collect() if r.sound) == sorted(W.described(r)["payload_digest"] for r in found)
    for cut in (raw[:-30], raw + b"junk that is long enough"):
        with pytest.raises(ValueError):
            list(W.members(io.BytesIO(cut)))


def test_damage_is_seen(spark, tmp_path):
    raw = W.record_bytes("urn:page:1", "http://a/", "response", hashlib.sha256(b"right").hexdigest(), 5, b"wrong", None)
    (tmp_path / "d.warc.gz").write_bytes(W.member(raw))
    index = W.index_archives(spark.createDataFrame([(str(tmp_path / "d.warc.gz"),)], "path string"))
    assert [r.sound for r in W.read_records(index).collect()] == [False]


def test_coalesced_ranges():
    rng = random.Random(3)
    for _ in range(200):
        ranges, at = [], 0
        for _ in range(rng.randrange(1, 40)):
            at += rng.choice([0, 0, 5, 50, 500])
            ranges.append(("a" if at < 2000 else "b", at, n := rng.randrange(1, 300)))
            at += n
        reads = list(W.coalesced(ranges, gap=50, run=1000))
        assert [(a, o, n) for a, _, _, inside in reads for o, n in inside] == ranges
        for (a, start, end, inside), after in zip(reads, [*reads[1:], None], strict=True):
            assert start == inside[0][0] and end == max(o + n for o, n in inside) and (end - start <= 1000 or len(inside) == 1)
            assert after is None or after[0] != a or after[1] > end + 50 or after[3][0][0] + after[3][0][1] - start > 1000


def test_few_reads_for_selected_records(spark, tmp_path, monkeypatch):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    index = W.write_archives(pages.coalesce(1), str(tmp_path / "w")).orderBy("offset")
    rows = index.collect()
    wanted = [r for k, r in enumerate(rows) if 100 <= k < 200 or k in (2500, 2501)]
    reads = list(W.coalesced(((r.archive, r.offset, r.length) for r in wanted), gap=64))
    assert [len(x[3]) for x in reads] == [100, 2]
    got = W.read_records(spark.createDataFrame(wanted, index.schema)).collect()
    assert sorted(r.record_id for r in got) == sorted(r.record_id for r in wanted) and all(r.sound for r in got)


def test_empty_and_clashing(spark, pages, tmp_path):
    index = W.write_archives(pages.where("false"), str(tmp_path / "e"))
    assert index.count() == 0 and W.read_records(index).count() == 0 and W.resolved(W.read_records(index)).count() == 0
    assert pafs.LocalFileSystem().get_file_info(pafs.FileSelector(str(tmp_path), recursive=True)) == [] or not list(tmp_path.rglob("*.warc.gz"))
    null = W.read_records(spark.createDataFrame([(None, 1, 2)], "archive string, offset long, length long"))
    assert null.count() == 0
