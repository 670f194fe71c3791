"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For a byte string every prefix has exactly one BPE encoding, so it has one last token. That token is found from the
tokens of shorter prefixes: a vocabulary entry that ends at the prefix is the last token iff the last token of what
stands before it may stand next to it. The table of last tokens is all that has to be stored: it grows at its
end when bytes are appended, and after an edit it is recomputed only until it agrees with the old table again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, documents, held_model, with_python
from .pretokens import split

#: Pre-tokens whose encoding a task remembers in each of two generations; when one is full, the older one goes.
REMEMBERED = 200_000
#: Pairs of tokens of which a coder remembers whether they may meet; when they are too many, all are forgotten.
PAIRS = 1_000_000
#: Bytes of text in one batch that goes back to Spark.
BATCH_BYTES = 4_000_000


class PrefixBPE:
    """Encoder and decoder over ``ranks``: token bytes to id, where a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self._together: dict[tuple[int, int], bool] = {}
        # finds every vocabulary entry in a byte string in one pass; bytes stand as the characters of the same numbers
        self._finder = ahocorasick.Automaton()
        for token, i in ranks.items():
            self._finder.add_word(token.decode("latin-1"), (i, len(token)))
        self._finder.make_automaton()

    @classmethod
    def load(cls, path: str) -> PrefixBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; None for a single byte."""
        whole = self.bytes_of[token]
        if len(whole) == 1:
            return None
        if token not in self._halves:
            parts = [self.ranks[whole[i : i + 1]] for i in range(len(whole))]
            while len(parts) > 2:
                merged = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], token) for a, b in zip(parts, parts[1:], strict=False)]
                least = min(merged)
                if least >= token:
                    raise ValueError(f"token {token} is not the result of merges")
                at = merged.index(least)
                parts[at : at + 2] = [least]
            self._halves[token] = (parts[0], parts[1])
        return self._halves[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` apart when they meet.

        Merges inside both run in the order of their ranks. Walking back through that order, only the piece of
        ``left`` that touches the border and the piece of ``right`` that touches it matter: if the two pieces that
        stood there at some time could merge before the next inner merge took one of them, the pair is not stable.
        """
        known = self._together.get((left, right))
        if known is None:
            if len(self._together) >= PAIRS:
                self._together.clear()
            known = self._together[left, right] = self._adjacent(left, right)
        return known

    def _adjacent(self, left: int, right: int) -> bool:
        # A state is the pair of border pieces and the rank of the merge that ended it (none for the last state).
        ended: float = float("inf")
        by_right = False
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            # at equal rank the merge further left goes first: the border lies left of a merge inside the right token
            if joined is not None and (joined < ended or (joined == ended and by_right)):
                return False
            l_parts, r_parts = self.halves(left), self.halves(right)
            if l_parts is None and r_parts is None:
                return True
            # the later of the two merges is undone first; at equal rank the right one ran later
            if r_parts is not None and (l_parts is None or right >= left):
                ended, by_right, right = right, True, r_parts[0]
            else:
                ended, by_right, left = left, False, l_parts[1]

    def extend(self, table: list[int], piece: bytes, until: int | None = None) -> list[int]:
        """Lengthen the table of last tokens (entry i: of the prefix of i + 1 bytes) up to ``until`` bytes of ``piece``."""
        together, adjacent, stop = self._together, self.adjacent, len(piece) if until is None else until
        base = max(0, len(table) - self.longest + 1)
        table += [-1] * (stop - len(table))
        for end, (token, length) in self._finder.iter(piece[base:stop].decode("latin-1")):
            end += base
            if table[end] < 0:
                start = end - length
                if start >= 0:
                    pair = (table[start], token)
                    if not (together[pair] if pair in together else adjacent(*pair)):
                        continue
                table[end] = token
        return table

    def read(self, table: list[int]) -> list[int]:
        """The tokens that a table stands for, from its end back to its start."""
        out, at = [], len(table)
        while at:
            token = table[at - 1]
            out.append(token)
            at -= len(self.bytes_of[token])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        return self.read(self.extend([], piece))

    def append(self, table: list[int], piece: bytes, more: bytes) -> list[int]:
        """The table of ``piece + more`` from that of ``piece``; nothing before is computed again."""
        return self.extend(list(table), piece + more)

    def edit(self, table: list[int], piece: bytes, at: int, removed: int, inserted: bytes) -> tuple[list[int], bytes]:
        """The table and bytes after replacing ``removed`` bytes at ``at``.

        An entry depends on the bytes of, and the entries inside, one longest token before it. So once that many new entries
        in a row equal the old ones behind the edit, all later ones do.
        """
        new = piece[:at] + inserted + piece[at + removed :]
        shift, out, same = len(inserted) - removed, list(table[:at]), 0
        while len(out) < len(new):
            self.extend(out, new, len(out) + 1)
            old = len(out) - 1 - shift
            same = same + 1 if old >= at + removed and table[old] == out[-1] else 0
            if same >= self.longest:
                out += table[old + 1 :]
        return out, new

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Memory(dict):
    """Pre-token to its ids as 32-bit integers in a byte string, made on first sight."""

    def __init__(self, coder: PrefixBPE):
        super().__init__()
        self.coder, self.older = coder, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(self.coder.encode(piece.encode()), dtype=np.int32).tobytes()
        self[piece] = ids
        return ids


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``bpe_ids`` (array<int>) and ``bpe_bytes`` (the ids decoded again).

    ``vocabulary`` is the place of a rank file, the same on all machines. Null counts as empty; an empty text has no ids and
    no bytes. Texts of any length are encoded whole, row by row, in batches of bounded size. Columns of ``docs``
    with these two names are replaced, others may have any name. Repeated rows give repeated results, an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("bpe_ids", "bpe_bytes")
    at = docs.columns.index(text_col)
    new = [T.StructField("bpe_ids", T.ArrayType(T.IntegerType())), T.StructField("bpe_bytes", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held_model(vocabulary, lambda: PrefixBPE.load(vocabulary))
        memory = _Memory(coder)  # goes with the task; a worker lives on through other stages
        for batch in batches:
            texts = batch.column(at)
            begin = 0
            while begin < batch.num_rows:
                end, size, ids, raw = begin, 0, [], []
                while end < batch.num_rows and size < BATCH_BYTES:
                    text = texts[end].as_py() or ""
                    own = np.frombuffer(b"".join(map(memory.__getitem__, split(text))), dtype=np.int32)
                    ids.append(own)
                    raw.append(coder.decode(own.tolist()))
                    size += len(raw[-1])
                    end += 1
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(raw, type=pa.binary())], names=[*batch.schema.names, "bpe_ids", "bpe_bytes"])
                begin = end

    return with_python(docs, run, new)


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256 and decoded_sha256 of :func:`encode_decode`'s result."""
    return encoded.select(
        *keep,
        F.size("bpe_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe_bytes"), 256).alias("decoded_sha256"),
    )


def production_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(documents(spark, sf_dir).select("doc_id", "text"), production_vocabulary()), "doc_id")
