"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language holds every substring of it. A text is parsed against each automaton from
left to right into longest matches; the language whose text needs the fewest phrases for each symbol wins. A letter that a language's
training text lacks is a phrase by itself there.

Texts are parsed whole. To use numpy, segments of texts are parsed side by side, each as if a phrase began at its start. Then the phrase that
comes in from the segment before is carried on until it ends where a phrase of the first parse ends as well: from there on both
parses are the same, since what follows depends on the place only. So the counts are those of a parse from left to right.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, documents, fresh, held_model, with_python

#: Bound of the training sample: labelled documents of a language, and characters of them that are used.
TRAIN_DOCS, TRAIN_CHARS = 40, 24_000
#: Documents up to this length are preferred for training, so that several speak for a language.
TRAIN_LENGTH = 4_000
#: Symbols in a segment; changes speed only.
SEGMENT = 512
#: Cells up to which transitions are a full table; larger alphabets have a hash table. Changes speed and memory only.
CELLS = 16_000_000
#: Lanes up to which what comes into a segment is carried on one by one; changes speed only.
FEW = 128
#: Symbols that are parsed together.
CHUNK = 4_000_000
#: Ends of phrases within a text, for each symbol, above which it speaks no learned language (a text of that language has about 0.2).
REJECT = 0.6

UNKNOWN = "und"


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept out of training: crc32 of the id as text modulo 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, text) for each label of the documents that are not held out; the text is a bounded sample, drawn by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    # one row for each language, as the model has; a literal in the plan, so most rows leave before their texts are shuffled
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return ()
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    shares = {lang: min(1.0, 8 * TRAIN_DOCS / n) * (1 << 40) for lang, n in counts.items()}
    few = F.element_at(F.map_from_arrays(F.lit(list(shares)), F.lit(list(shares.values()))), F.col("lang"))
    order = Window.partitionBy("lang").orderBy((F.length("text") > TRAIN_LENGTH) | (F.length("text") < 40), draw, "id", "text")
    chosen = rows.where(F.col("text").isNotNull() & (draw < few)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= TRAIN_DOCS)
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.select("lang", "k", F.substring("text", 1, TRAIN_CHARS).alias("text")).collect():
        texts.setdefault(r["lang"], []).append((r["k"], r["text"]))
    return tuple((lang, " ".join(t for _, t in sorted(texts[lang]))[:TRAIN_CHARS]) for lang in sorted(texts))


class Alphabet:
    """Maps code points to symbols: 0 for what is no letter, 1 for letters that no training text has, 2 and up for all that one has."""

    def __init__(self, texts: list[str]):
        letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        self.size = len(letters) + 2
        self.table = np.array([chr(c).isalpha() for c in range(0x110000)], dtype=np.int32)
        for k, c in enumerate(letters):
            for form in (c.upper(), c.title(), c):
                if len(form) == 1:
                    self.table[ord(form)] = k + 2

    def symbols(self, text: str) -> np.ndarray:
        """The text's symbols, each run of 0 as one."""
        s = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        return s[(s != 0) | np.append(True, s[:-1] != 0)] if len(s) else s


class SuffixAutomaton:
    """All substrings of a sequence. State 1 stands for 'a phrase is over': from it every symbol begins a new one.

    ``step`` gives the state after a symbol, or ~t where a phrase ends before the symbol and the next begins with it: t is the state
    after that one symbol, which is 1 for a symbol that the sequence lacks.
    """

    def __init__(self, symbols: list[int], size: int):
        to: list[dict[int, int]] = [{}, {}]
        link, length, last = [-1, -1], [0, 0], 0
        for c in symbols:
            now = len(to)
            to.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in to[p]:
                to[p][c] = now
                p = link[p]
            if p >= 0:
                q = to[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    copy = len(to)
                    to.append(dict(to[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[now] = copy
                    while p >= 0 and to[p].get(c) == q:
                        to[p][c] = copy
                        p = link[p]
            last = now
        own = sorted(to[0])
        self.width = len(own) + 1
        #: From symbols of the common alphabet to those of this sequence; all that it lacks share the last.
        self.own = np.full(size, len(own), dtype=np.int32)
        self.own[own] = np.arange(len(own), dtype=np.int32)
        self.begin = np.array([~to[0][c] for c in own] + [~1], dtype=np.int32)
        source = np.repeat(np.arange(len(to), dtype=np.int64), [len(moves) for moves in to])
        key = source * self.width + self.own[np.array([c for moves in to for c in moves], dtype=np.int64)]
        value = np.array([t for moves in to for t in moves.values()], dtype=np.int32)
        self.full = len(to) * self.width <= CELLS
        if self.full:
            self.table = np.tile(np.where(self.begin < 0, ~(~self.begin * self.width), 0).astype(np.int32), len(to))
            self.table[key] = value * self.width
        else:
            self.bits = np.uint64(64 - max(4, int(4 * len(key)).bit_length()))
            self.keys = np.full(1 << (64 - int(self.bits)), -1, dtype=np.int64)
            self.table = np.zeros(len(self.keys), dtype=np.int32)
            for k, v, at in zip(key.tolist(), value.tolist(), self._place(key).tolist(), strict=True):
                while self.keys[at] >= 0:
                    at = (at + 1) % len(self.keys)
                self.keys[at], self.table[at] = k, v

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.bits).astype(np.int64)

    @property
    def over(self) -> int:
        """State 1 as ``step`` has it; in a full table states are known by where their row begins."""
        return self.width if self.full else 1

    def look_up(self) -> Callable[[int, int], int]:
        """``step`` for one state and one symbol."""
        if self.full:
            item = self.table.item
            return lambda state, symbol: item(state + symbol)
        held = self.keys >= 0
        moves, begin, width = dict(zip(self.keys[held].tolist(), self.table[held].tolist(), strict=True)), self.begin.tolist(), self.width
        return lambda state, symbol: moves.get(state * width + symbol, begin[symbol])

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """``symbol`` counts by the sequence's own alphabet (``own``)."""
        if self.full:
            return self.table.take(state + symbol)
        key = state * np.int64(self.width) + symbol
        at, out, look = self._place(key), self.begin[symbol], np.arange(len(key))
        while len(look):
            held = self.keys[at[look]]
            hit = look[held == key[look]]
            out[hit] = self.table[at[hit]]
            look = look[(held >= 0) & (held != key[look])]
            at[look] = (at[look] + 1) % len(self.keys)
        return out


class CrossParser:
    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        self.alphabet = Alphabet([t for _, t in samples])
        self.automata = [SuffixAutomaton(self.alphabet.symbols(t).tolist(), self.alphabet.size) for _, t in samples]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, language): the number of phrases."""
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        n_segments = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), n_segments)
        if not len(owner):
            return out
        start = np.append(0, np.cumsum(lengths)[:-1])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
        begin, size = start[owner] + within * SEGMENT, np.minimum(SEGMENT, lengths[owner] - within * SEGMENT)
        order = np.argsort(-size, kind="stable")
        lane = np.empty(len(order), dtype=np.int64)
        lane[order] = np.arange(len(order))
        # of each lane, the one that holds the next segment of the same text
        follows = np.full(len(order), -1, dtype=np.int64)
        inner = np.flatnonzero(within[1:] > 0)
        follows[lane[inner]] = lane[inner + 1]
        begin, size, owner = begin[order], size[order], owner[order]
        flat = np.concatenate([*texts, np.zeros(SEGMENT, dtype=np.int32)])
        # lane k of step i is symbol i of segment k; lanes are sorted by length, so those still running come first
        steps = np.ascontiguousarray(flat[begin[:, None] + np.arange(size[0])].T)
        running = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right").tolist()
        for k, automaton in enumerate(self.automata):
            counts = self._parse(automaton, automaton.own[steps], running, size, follows, order)
            out[:, k] = np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
        return out

    @staticmethod
    def _parse(automaton: SuffixAutomaton, steps: np.ndarray, running: list[int], size: np.ndarray, follows: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The phrases that begin in each lane; ``place`` is the lane's segment in the order of the texts."""
        state, count = np.full(len(size), automaton.over, dtype=np.int32), np.zeros(len(size), dtype=np.int64)
        begins = np.zeros(steps.shape, dtype=bool)
        for i, n in enumerate(running):
            now = automaton.step(state[:n], steps[i, :n])
            ended = now >> 31  # -1 where a phrase ended
            count[:n] -= ended
            begins[i, :n] = ended
            state[:n] = now ^ ended
        # carry on what comes in, side by side while many lanes are left
        change, end = np.zeros(len(size), dtype=np.int64), state.copy()
        sends = np.flatnonzero(follows >= 0)
        lanes, coming, at, unmet = follows[sends], state[sends], np.arange(len(sends)), []
        for i in range(len(running)):
            if len(at) <= FEW:
                break
            now = automaton.step(coming[at], steps[i, lanes[at]])
            ended, first = now < 0, begins[i, lanes[at]]
            change[lanes[at]] += ended.astype(np.int64) - first
            coming[at] = np.where(ended, ~now, now)
            met, over = ended & first, size[lanes[at]] == i + 1
            unmet.append(lanes[at[over & ~met]])
            at = at[~met & ~over]
        # lanes at whose end the parses had not met, and those left, are done one by one in the order of the text, since each may change what the next one begins with
        before = np.full(len(size), -1, dtype=np.int64)
        before[lanes] = sends
        left = np.unique(place[np.concatenate([lanes[at], *unmet])]).tolist()  # sorted, so a heap
        look_up, lane_of = automaton.look_up(), np.argsort(place)
        done = -1
        while left:
            k = heapq.heappop(left)
            if k == done:
                continue
            done, lane = k, int(lane_of[k])
            now_at, differ, met_at = int(end[before[lane]]), 0, False
            for c, first in zip(steps[: size[lane], lane].tolist(), begins[: size[lane], lane].tolist(), strict=True):
                now = look_up(now_at, c)
                if now < 0:
                    now_at = ~now
                    if first:
                        met_at = True
                        break
                    differ += 1
                else:
                    now_at = now
                    differ -= first
            change[lane] = differ
            last = int(state[lane]) if met_at else now_at
            if last != end[lane]:
                end[lane] = last
                if follows[lane] >= 0:
                    heapq.heappush(left, int(place[follows[lane]]))
        return count + change

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and rate of each text.

        The score is the margin by which the best language needs fewer phrases than the second, from 0 to 1; the rate is how many phrases end
        within the text, for each symbol, so a text that is one phrase has rate 0, however short.
        """
        langs, scores, rates = [], [], []
        block: list[np.ndarray] = []

        def close() -> None:
            found = self.phrases(block)
            for symbols, phrases in zip(block, found, strict=True):
                if not (symbols > 0).any() or not self.langs:
                    langs.append(UNKNOWN), scores.append(0.0), rates.append(1.0)
                    continue
                best = int(np.argmin(phrases))  # of equal ones the first, and languages are in order
                second = int(np.min(np.delete(phrases, best))) if len(phrases) > 1 else len(symbols)
                langs.append(self.langs[best]), rates.append((int(phrases[best]) - 1) / len(symbols))
                scores.append(max(0.0, 1 - int(phrases[best]) / second))
            block.clear()

        size = 0
        for text in texts:
            block.append(self.alphabet.symbols(text or ""))
            size += len(block[-1])
            if size >= CHUNK:
                close()
                size = 0
        close()
        return langs, scores, rates


#: Columns that :func:`identify` adds.
ADDED = ("lang_pred", "score", "rate")


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (0 to 1) and rate (ends of phrases for each symbol), which replace columns so named.

    ``samples`` come from :func:`train`. Null texts, texts without a letter and, if nothing was learned, all texts are ``und`` with score 0
    and rate 1. Whole texts are parsed; equal texts get equal results; of languages with equal rates the first by name
    wins. An empty table gives an empty one. Other columns may have any name.
    """
    bounded_batches(docs.sparkSession)
    news = ADDED
    if text_col in news:
        docs = docs.withColumnRenamed(text_col, text_col := fresh(docs, "text_in"))
    docs = docs.drop(*news)
    at = docs.columns.index(text_col)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rate", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held_model(samples, lambda: CrossParser(samples))
        for batch in batches:
            langs, scores, rates = parser.predict(batch.column(at).to_pylist())
            new = [pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64()), pa.array(rates, type=pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *news])

    return with_python(docs, run, added)


def accepted():
    """Whether a document of :func:`identify`'s result speaks a learned language."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("rate") <= REJECT)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
