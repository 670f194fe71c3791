"""BPE and token counts against the libraries."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiflow.llm import bpe, token_counts
from lexiflow.llm.pretokens import split

ALPHABET = "aabcdeee  \n\t'sdt.,;:019é漢字ß\x1c\x85\xa0 ²½ʰ̀😀"


@pytest.fixture(scope="module")
def coder():
    return bpe.PrefixBPE.load(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def texts():
    r = random.Random(1)
    some = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    return [*some, "", "a" * 2000, " " * 700 + "x", "<|endoftext|>a<|endoftext|>", "word " * 3000]


def test_encoding_is_the_librarys(coder, library):
    for t in texts():
        ids = [i for p in split(t) for i in coder.encode(p.encode())]
        assert ids == library.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_appends_and_edits(coder):
    r = random.Random(2)
    for _ in range(200):
        s = bytes(r.choice(b"abcthe \xc3\xa9ing") for _ in range(r.randint(1, 500)))
        table = coder.extend([], s)
        at = r.randint(0, len(s))
        removed, new = r.randint(0, min(5, len(s) - at)), bytes(r.choice(b"xthe") for _ in range(r.randint(0, 6)))
        edited, whole = coder.edit(table, s, at, removed, new)
        assert whole == s[:at] + new + s[at + removed :] and edited == coder.extend([], whole)
        assert coder.append(table, s, new) == coder.extend([], s + new)


def test_counts_are_the_librarys():
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    merger = token_counts._worker(P.path("byte_bpe_50k.json"))
    all_ = texts()
    assert merger.count_texts(all_) == [len(x.ids) for x in tokenizer.encode_batch(all_, add_special_tokens=False)]


ROWS = [(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "é漢 " * 5000), (4, "<|endoftext|>")]


def test_operators(spark, library):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("bpe_ids", F.lit("mine")).withColumn("n_tokens", F.lit("mine"))
    rows = bpe.encode_decode(d, bpe.production_vocabulary()).collect()
    assert [(r.doc_id, r.text) for r in rows] == ROWS
    assert [r.bpe_ids for r in rows] == [library.encode_ordinary(t or "") for _, t in ROWS]
    assert [bytes(r.bpe_bytes) for r in rows] == [(t or "").encode() for _, t in ROWS]
    out = {r.doc_id: r for r in bpe.digests(bpe.encode_decode(d, bpe.production_vocabulary()), "doc_id").collect()}
    assert out[1].ids_sha256 == hashlib.sha256(b"31373 995").hexdigest() and out[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    counted = token_counts.count_tokens(d, token_counts.production_description()).collect()
    assert [r.n_tokens for r in counted][:4] == [2, 0, 0, 0] and counted[5].n_tokens == 1
    assert bpe.encode_decode(d.where("false"), bpe.production_vocabulary()).count() == 0 == token_counts.count_tokens(d.where("false"), token_counts.production_description()).count()
