"""Token counts by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of a batch lie one after the other in one array of symbols. In each round every sequence finds its
lowest-ranked pair, all sequences merge theirs at once, and sequences without a pair leave with their number of symbols.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, documents, fresh, with_python
from .pretokens import split

#: Pre-tokens whose count a worker remembers; the memory is emptied when it is full.
REMEMBERED = 600_000
#: Characters of text that are split before their new pre-tokens are merged together.
BLOCK = 4_000_000
#: The count above which a document does not fit.
LIMIT = 512


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class RankMerger:
    """Counts tokens by a byte-level BPE description of the ``tokenizers`` library."""

    def __init__(self, description: dict):
        model, before = description["model"], description["pre_tokenizer"]
        if model["type"] != "BPE" or description["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
        vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        self.symbol = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        added = [t["content"] for t in description.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.memory: dict[str, int] = {}

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece."""
        out = np.zeros(len(pieces), dtype=np.int64)
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        owner = np.repeat(np.arange(len(pieces)), length)
        symbols = self.symbol[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        none = len(self.made)
        while len(symbols):
            # the pair at i joins symbols i and i + 1; the last of a sequence has none
            inner = np.append(owner[1:] == owner[:-1], False)
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[at] == key, self.rank[at], none), none)
            rank[~inner] = none
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(first, len(owner)))
            least = np.minimum.reduceat(rank, first)
            done = least == none
            out[owner[first[done]]] = length[done]
            chosen = (rank == np.repeat(least, length)) & (rank < none)
            # of overlapping choices (aaa) every second one counts, from the left
            here = np.arange(len(chosen))
            gap = np.maximum.accumulate(np.where(chosen, -1, here))
            chosen &= (here - gap) % 2 == 1
            symbols[chosen] = self.made[rank[chosen]]
            stays = np.repeat(~done, length)
            stays[1:] &= ~chosen[:-1]
            symbols, owner = symbols[stays], owner[stays]
        return out

    def count_texts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; added tokens inside a text count one each, as by the library's default."""
        split_texts, extra = [], []
        for text in texts:
            parts = self.added.split(text) if self.added else [text]
            extra.append(len(parts) - 1)
            split_texts.append(split(parts[0]) if len(parts) == 1 else [p for x in parts for p in split(x)])
        memory = self.memory
        new = {p for pieces in split_texts for p in pieces if p not in memory}
        if len(memory) + len(new) > REMEMBERED:
            memory = self.memory = {}
            new = {p for pieces in split_texts for p in pieces}
        new = list(new)
        memory.update(zip(new, self.counts([p.encode() for p in new]).tolist(), strict=True))
        return [sum(map(memory.__getitem__, pieces)) + more for pieces, more in zip(split_texts, extra, strict=True)]


@lru_cache(maxsize=2)
def _worker(path: str) -> RankMerger:
    with open(path, encoding="utf-8") as f:
        return RankMerger(json.load(f))


def count_tokens(docs: DataFrame, description: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` with ``out_col`` (long), which replaces a column of that name; others may have any name.

    ``description`` is the place of the tokenizer's file, the same on all machines. Null counts as empty, and an empty text has no
    tokens. Texts are counted whole. Repeated rows give repeated counts, an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out_col) if out_col != text_col else docs.withColumnRenamed(text_col, text_col := fresh(docs, "text_in"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _worker(description)
        for batch in batches:
            found, block, size = [], [], 0
            for text in batch.column(at):
                block.append(text.as_py() or "")
                size += len(block[-1])
                if size >= BLOCK:
                    found += merger.count_texts(block)
                    block, size = [], 0
            found += merger.count_texts(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, type=pa.int64())], names=[*batch.schema.names, out_col])

    return with_python(docs, run, [T.StructField(out_col, T.LongType())])


def production_description() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(documents(spark, sf_dir).select("doc_id", "text"), production_description())
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
