"""The queries' own columns over the smallest tables, against the libraries or plain code over whole texts."""

import hashlib
import os
import re

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from lexiflow.llm import bpe, jaccard_join, licenses, pii, token_counts

from .test_text_operators import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(df):
    found = df.collect()
    by = {r.doc_id: r for r in found}
    assert len(by) == len(found)
    return by


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def test_op5(spark, texts):
    got = rows(licenses.op5_license_scan(spark, SF))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts, labels = [k for k, _ in places], sorted({x for _, x in places})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(labels))
        found = r.labels.split(",") if r.labels else []
        assert set(labels) <= set(found) and found == sorted(set(found)) and 0 <= r.score <= 1


def test_op6(spark, texts):
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = rows(bpe.op6_byte_bpe(spark, SF))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = coder.encode(text, disallowed_special=())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))


def test_op7(spark, texts):
    want = brute(list(texts.items()))
    got = rows(jaccard_join.op7_ngram_jaccard(spark, SF))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_op8(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = rows(token_counts.op8_token_counts(spark, SF))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 512)


def luhn(digits: str) -> bool:
    twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def test_op9(spark, texts):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    got = rows(pii.op9_pii(spark, SF))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        spans = {k: [m.span() for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in kinds.items()}
        base = ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(spans[k]) for k in kinds] and r.base_sha256 == sha(base.encode())
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_op7_with_few_and_many_buckets(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join.join_similar(docs).collect()))
    assert sorted(map(tuple, jaccard_join.join_similar(docs, share=100).collect())) == want
