"""Sets of hashed word shingles, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Words in a shingle.
WORDS = 5
#: Bytes of text that are hashed together.
CHUNK = 250_000

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random number for each byte; A-Z have those of a-z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the word hash and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_P), -1, 2**64))
    both = []
    for base in (_P, inverse):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def _hash_chunk(texts: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    size = 1 << max(18, int(len(raw)).bit_length())
    up, down = _powers(size)
    white = _WHITE[raw]
    inner = ~white
    start = np.flatnonzero(inner & np.append(True, white[:-1]))
    end = np.flatnonzero(white & np.append(False, inner[:-1]))
    # sum of byte * base^position up to each place; a word is the difference of two, shifted back to position 0
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    word = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    edges = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(start, edges)
    first = np.append(0, last[:-1])
    if len(word) >= WORDS:
        rolling = np.zeros(len(word) - WORDS + 1, dtype=np.uint64)
        for k in range(WORDS):
            rolling = rolling * _Q + word[k : k + len(rolling)]
        rolling = mixed(rolling)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        n = b - a
        if n >= WORDS:
            out.append(np.unique(rolling[a : b - WORDS + 1]))
        elif n:
            few = np.uint64(n)
            for w in word[a:b]:
                few = few * _Q + w
            out.append(mixed(np.array([few + np.uint64(1)])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The set of each text as a sorted array of 64-bit hashes.

    Words are runs of bytes other than space and U+0009 to U+000D, A-Z lower-cased. A text of fewer words than a shingle
    has its whole sequence as the only element; one without words has the empty set.
    """
    chunk, size = [], 0
    with np.errstate(over="ignore"):
        for text in texts:
            chunk.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from _hash_chunk(chunk)
                chunk, size = [], 0
        if chunk:
            yield from _hash_chunk(chunk)
