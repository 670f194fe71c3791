"""Similarity join on word shingles with PartEnum signatures.

Two sets with Jaccard similarity of at least 0.8 and sizes a and b differ in at most (a + b) / 9 elements, so in at most a / 4. Sizes
fall into bands [2^j, 2^(j+1)); a set also takes part in the next band if a partner can be there. In a band the domain of shingles is
split by hash into first-level partitions, alike for all its sets.

1. Count. A signature of a whole partition is the hash of what a set has in it. Similar sets agree in all but a / 4 of the p partitions of
   their band, so a set of which fewer than p - a / 4 signatures occur in any other set links with nothing and is done. In
   each task signatures are combined first: one that several of its sets have is credited there and goes on once, so
   a passage that many documents share costs a row a task. What is counted are whole-corpus facts; nothing is sampled.
2. Enumerate. The sets that are left get the signatures of PartEnum: each first-level partition is split into three, and each
   subset of two of them gives a signature. Two sets that differ in one element of a partition still share one of its three. With
   q partitions, similar sets share at least c of their 3 q signatures (:func:`shared_subsets`), so each set may leave out
   the c - 1 that most sets have; of an order by exact frequency the first shared one is kept on both sides, and no link is lost.
3. Verify. Copies of one set form a class with the least id as representative. Representatives that share a signature are verified by exact
   intersection: first each one against the best connected member of its signature groups, in rounds for as long as that closes
   groups, then all pairs that share a signature but are in different components. These are compared in blocks of a group by parity
   sketches, whose distance is a lower bound of the sets' difference; only pairs that the bound admits are emitted.

Sets are sets of 64-bit hashes: two shingles with one hash count as one, which happens to one pair of 2^64. Signatures and their owners
travel with 40 bits each within a bucket; equal ones by chance only leave a set more to verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, documents, staged, tidy
from .components import connected_components
from .shingles import mixed, shingle_sets

#: Second-level partitions of a first-level one, and how many of them a signature leaves out.
SECOND, LEFT_OUT = 3, 1
#: Most rounds against the best connected members, and the share of signature rows that a round has to close for another one.
ROUNDS, WORTH = 6, 0.2
#: Bytes of sketches of a group that are compared in one block, and pairs that go back to Spark together, about.
BLOCK, PAIRS = 2_000_000, 100_000
#: Shingles whose signatures are made together.
TOGETHER = 400_000
#: Bytes of text whose signatures make up one bucket, about: some 12 MB, which a task sorts at once. So there are more buckets for more text.
SHARE = 8 << 20
#: Rows of texts that a task works on at once.
ROWS = 1000


def similar(both: int, a: int, b: int) -> bool:
    return 100 * both >= 80 * (a + b - both)


def _bands(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which sets, band) for the sets' own bands and for the next ones, where a partner of 5/4 of the size is in it."""
    own = np.frexp(n.astype(np.float64))[1] - 1
    upper = np.flatnonzero(5 * n >= 4 * (1 << (own + 1)))
    return [(np.arange(len(n)), own), (upper, own[upper] + 1)]


def whole_partitions(band: np.ndarray) -> np.ndarray:
    """First-level partitions of a band for the count: a fifth more than sets of the band can differ in."""
    return np.maximum(4, (3 << band) // 5)


def enumerated_partitions(band: np.ndarray) -> np.ndarray:
    """First-level partitions of a band for the enumeration: a fifth more than half of what sets of the band can differ in."""
    return np.maximum(3, (3 << band) // 10 + 1)


def shared_subsets(n: np.ndarray, partitions: np.ndarray) -> np.ndarray:
    """The least number of signatures that a set of ``n`` elements shares with any similar one.

    Each of up to n / 4 differences leaves one of a partition's three subsets, and another one in the same partition, none.
    """
    k = n // 4
    return np.where(k <= partitions, SECOND * partitions - 2 * k, 2 * partitions - k)


def signatures(flat: np.ndarray, n: np.ndarray, band: np.ndarray, partitions: np.ndarray, second: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of sets of sorted hashes, laid end to end in ``flat``, ``n`` elements each.

    With ``second`` = 1 there is one signature for each partition, else one for each second-level partition that is left out.
    """
    base = np.append(0, np.cumsum(partitions))
    owner = np.repeat(np.arange(len(n)), n)
    cell = ((flat >> np.uint64(32)) * (partitions * second).astype(np.uint64)[owner] >> np.uint64(32)).astype(np.int64) + base[owner] * second
    content = np.zeros(base[-1] * second, dtype=np.uint64)
    if len(cell):  # cells rise with the elements, so each is a run
        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        content[cell[start]] = np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), start)
    if second > 1:
        content = content.reshape(-1, second)
        content = (content.sum(axis=1, dtype=np.uint64)[:, None] - content).ravel()
    who = np.repeat(np.arange(len(n)), partitions * second)
    place = np.arange(len(content), dtype=np.int64) - (base[:-1] * second)[who]
    return mixed(content + mixed((place + (band[who].astype(np.int64) << 40)).astype(np.uint64))), who


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            yield batch.slice(begin, ROWS)


def _sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return shingle_sets([x.as_py() or b"" for x in batch.column(1)])


def _fingerprints(items: np.ndarray) -> tuple[int, int]:
    return int(mixed(items).sum(dtype=np.uint64)), int(mixed(items ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64))


# ---------------------------------------------------------------- count

_FOUND = "bucket int, kind int, doc_id long, n long, fp1 long, fp2 long, sigs binary"
#: Kinds of rows: a document, signatures of a bucket, and how many signatures of an owner are shared.
_DOCUMENT, _SIGNATURES, _CREDIT = 0, 1, 2
#: A signature's bucket is in its upper bits; of the rest, and of its owner, 40 bits are kept. Owner 0: several sets.
_KEPT = np.uint64((1 << 40) - 1)
_SHARED = 0


def _rows(kind: int, bucket, doc_id=None, n=None, fp1=None, fp2=None, sigs=None) -> pa.RecordBatch:
    size = len(bucket)
    long = lambda x: pa.nulls(size, pa.int64()) if x is None else x.cast(pa.int64()) if isinstance(x, pa.Array) else pa.array(x, type=pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, type=pa.int32()), pa.array(np.full(size, kind, dtype=np.int32)), long(doc_id), long(n), long(fp1), long(fp2), pa.nulls(size, pa.binary()) if sigs is None else pa.array(sigs, type=pa.binary())],
        names=["bucket", "kind", "doc_id", "n", "fp1", "fp2", "sigs"],
    )


def _owner(fp: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The key under which a class is credited: 39 bits of its fingerprint, never 0, and whether its next band is meant."""
    return (np.maximum(fp & (_KEPT >> np.uint64(1)), np.uint64(1)) << np.uint64(1)) | upper.astype(np.uint64)


def _pack(sig: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Ten bytes for each signature: five of it, five of its owner."""
    both = np.stack([sig & _KEPT, owner], axis=1).astype("<u8").view(np.uint8).reshape(-1, 2, 8)
    return np.ascontiguousarray(both[:, :, :5]).reshape(-1, 10)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.zeros((len(raw) // 10, 2, 8), dtype=np.uint8)
    both[:, :, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 2, 5)
    both = both.reshape(-1, 16).view("<u8")
    return both[:, 0], both[:, 1]


def _scan(buckets: int):
    """A row for each document, and the whole-partition signatures of each class by bucket, combined within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes of this task whose signatures are out
        sets: list[np.ndarray] = []
        prints: list[int] = []
        size = 0
        with np.errstate(over="ignore"):
            for batch in _sliced(batches):
                sizes, fps = [], []
                for id_, items in zip(batch.column(0).to_pylist(), _sets_of(batch), strict=True):
                    fp = _fingerprints(items)
                    sizes.append(len(items))
                    fps.append(fp)
                    if id_ is not None and len(items) >= 4 and fp[0] not in seen:
                        seen.add(fp[0])
                        sets.append(items)
                        prints.append(fp[0])
                        size += len(items)
                        if size >= TOGETHER:
                            yield from combined(sets, prints)
                            sets, prints, size = [], [], 0
                fp = np.array(fps, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield _rows(_DOCUMENT, (fp[:, 0] % buckets).astype(np.int32), batch.column(0), sizes, fp[:, 0], fp[:, 1])
            if sets:
                yield from combined(sets, prints)

    def combined(sets: list[np.ndarray], prints: list[int]) -> Iterator[pa.RecordBatch]:
        n, fp = np.array([len(s) for s in sets]), np.array(prints, dtype=np.uint64)
        flat, ends = np.concatenate(sets), np.cumsum(n)
        found = []
        for up, (which, band) in enumerate(_bands(n)):
            part = flat if up == 0 else np.concatenate([flat[:0], *(flat[ends[i] - n[i] : ends[i]] for i in which)])
            sig, who = signatures(part, n[which], band, whole_partitions(band), 1)
            found.append((sig, _owner(fp[which], np.full(len(which), up))[who]))
        sig, owner = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(sig)
        sig, owner = sig[order], owner[order]
        first = np.append(True, sig[1:] != sig[:-1])
        several = np.append(sig[1:] == sig[:-1], False)  # in the first place of a run: it has more than one
        shared = ~first | several
        if shared.any():
            who, times = np.unique(owner[shared], return_counts=True)
            yield _rows(_CREDIT, (who % np.uint64(buckets)).astype(np.int32), n=times, fp1=who.astype(np.int64))
        owner[several] = _SHARED
        sig, owner = sig[first], owner[first]
        bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        packed = _pack(sig, owner)
        ends = np.append(cut[1:], len(bucket)).tolist()
        yield _rows(_SIGNATURES, bucket[cut], sigs=[packed[a:b].tobytes() for a, b in zip(cut.tolist(), ends, strict=True)])

    return run


def _credited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of other kinds as they are; for the signatures, which arrive bucket by bucket, how many of each owner's another one has as well."""
    current, blobs = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not blobs:
            return
        sig, owner = _unpack(b"".join(blobs))
        order = np.argsort(sig)
        sig, owner = sig[order], owner[order]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        apart = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
        hit = np.repeat(apart, np.diff(np.append(start, len(sig)))) & (owner != _SHARED)
        if hit.any():
            who, times = np.unique(owner[hit], return_counts=True)
            yield _rows(_CREDIT, np.full(len(who), current, np.int32), n=times, fp1=who.astype(np.int64))

    for batch in batches:
        own = batch.column(1).to_numpy() == _SIGNATURES
        if not own.all():
            yield batch.filter(pa.array(~own))
        for i in np.flatnonzero(own).tolist():
            bucket = batch.column(0)[i].as_py()
            if bucket != current:
                yield from flush()
                current, blobs = bucket, []
            blobs.append(batch.column(6)[i].as_py())
    yield from flush()


def _left(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id): representatives of the classes that share as many signatures as a similar set would."""
    credits = found.where(F.col("kind") == _CREDIT).groupBy(F.col("fp1").alias("owner")).agg(F.sum("n").alias("shared"))
    key = F.shiftleft(F.greatest(F.col("fp1").bitwiseAND(F.lit((1 << 39) - 1)), F.lit(1)), 1)
    log = (F.length(F.bin("n")) - 1).cast("int")
    rows = classes.where("n >= 4").select("rep", "n", key.alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up"), log.alias("log"))
    partitions = F.greatest(F.lit(4), F.floor(3 * F.pow(F.lit(2.0), F.col("log") + F.col("up")) / 5)).cast("long")
    rows = rows.select("rep", (F.col("key") + F.col("up")).alias("owner"), (partitions - F.floor(F.col("n") / 4)).alias("need"))
    return rows.join(credits, "owner").where("shared >= need").select(F.col("rep").alias("doc_id")).distinct()


# ---------------------------------------------------------------- enumerate


def _sketch(items: np.ndarray) -> bytes:
    """A bit for each residue of the hashes modulo a power of two of 2 to 4 times their number: the parity of the elements there.

    The sketches of two sets differ in the parities of their difference, so in no more bits than the sets do in elements. A sketch
    of twice the length is folded by exclusive or.
    """
    bits = 1 << max(8, int(len(items)).bit_length() + 1)
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


_SETS = "doc_id long, fp long, up int, n long, c long, items binary, sketch binary, sigs array<long>"


def _enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its set, sketch and enumerated signatures, and a second row if it takes part in the next band."""
    for batch in _sliced(batches):
        out: dict[str, list] = {c: [] for c in ("doc_id", "fp", "up", "n", "c", "items", "sketch", "sigs")}
        size = 0
        with np.errstate(over="ignore"):
            for id_, items in zip(batch.column(0).to_pylist(), _sets_of(batch), strict=True):
                if len(items) < 4:
                    continue
                n = np.array([len(items)])
                fp = np.array([_fingerprints(items)[0]], dtype=np.uint64).view(np.int64)[0]
                for up, (which, band) in enumerate(_bands(n)):
                    if len(which):
                        q = enumerated_partitions(band)
                        sig, _ = signatures(items, n, band, q, SECOND)
                        row = (id_, fp, up, len(items), int(shared_subsets(n, q)[0]), None if up else items.tobytes(), None if up else _sketch(items), sig.view(np.int64))
                        for column, value in zip(out.values(), row, strict=True):
                            column.append(value)
                        size += len(sig)
                if size >= TOGETHER:
                    yield _set_rows(out)
                    out, size = {c: [] for c in out}, 0
        if out["n"]:
            yield _set_rows(out)


def _set_rows(out: dict[str, list]) -> pa.RecordBatch:
    offsets = np.zeros(len(out["sigs"]) + 1, dtype=np.int32)
    np.cumsum([len(s) for s in out["sigs"]], out=offsets[1:])
    sigs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out["sigs"])))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(v, type=t) for v, t in zip(list(out.values())[:-1], types, strict=True)), sigs], names=list(out))


def _groups(sets: DataFrame) -> DataFrame:
    """(sig, doc_id): the signatures of each set that several sets have, without the c - 1 most frequent ones."""
    rows = sets.select("doc_id", "fp", "up", "c", F.explode("sigs").alias("sig"))
    size = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = staged(rows.join(size, "sig"), "shared")
    of_set = Window.partitionBy("doc_id", "fp", "up")
    ranked = shared.withColumn("k", F.row_number().over(of_set.orderBy("size", "sig"))).withColumn("all", F.count(F.lit(1)).over(of_set))
    return ranked.where("k <= all - c + 1").select("sig", "doc_id").distinct()


# ---------------------------------------------------------------- verify


def _possible(open_: DataFrame, sketches: DataFrame) -> DataFrame:
    """(src, dst): pairs of a signature group in different components that the sketches do not tell apart.

    Large groups are cut into chunks that meet two by two, so neither memory nor time of a task depends on the size of a group.
    """
    rows = open_.join(sketches, "doc_id")
    size = rows.groupBy("sig").agg(F.ceil(F.sum(F.octet_length("sketch")) / BLOCK).cast("int").alias("chunks"))
    rows = rows.join(size, "sig").withColumn("c", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int"))
    rows = rows.select("sig", "doc_id", "comp", "n", "sketch", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("x"))
    rows = rows.select("sig", F.least("c", "x").alias("lo"), F.greatest("c", "x").alias("hi"), "c", "doc_id", "comp", "n", "sketch")
    rows = rows.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "n")

    def of(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, comps, sizes, chunk = (t.column(c).to_numpy() for c in ("doc_id", "comp", "n", "c"))
        raw = t.column("sketch").to_pylist()
        length = np.array([len(x) for x in raw])  # rises with the size
        inside = bool((chunk == chunk[0]).all())  # a block of one chunk, or of two that meet
        top = np.searchsorted(sizes, sizes * 5 // 4, side="right")
        for width in np.unique(length).tolist():
            a, b = np.searchsorted(length, [width, width + 1])
            end = np.searchsorted(length, 2 * width, side="right")
            same = np.frombuffer(b"".join(raw[a:b]), dtype=np.uint64).reshape(b - a, -1)
            more = np.frombuffer(b"".join(raw[b:end]), dtype=np.uint8).reshape(end - b, 2, -1) if end > b else None
            if more is not None:  # the residue modulo half the length is the same in both halves
                same = np.concatenate([same, np.ascontiguousarray(more[:, 0] ^ more[:, 1]).view(np.uint64)])
            for i in range(a, b):
                j = np.arange(i + 1, min(top[i], end))
                j = j[(comps[j] != comps[i]) & (inside | (chunk[j] != chunk[i]))]
                if len(j):
                    apart = np.bitwise_count(same[j - a] ^ same[i - a]).sum(axis=1, dtype=np.int64)
                    j = j[9 * apart <= sizes[j] + sizes[i]]
                    yield np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, found = [], [], 0
        for block in _blocks(batches):
            for a, b in of(block):
                src.append(a)
                dst.append(b)
                found += len(a)
                if found >= PAIRS:
                    yield as_batch(src, dst)
                    src, dst, found = [], [], 0
        if found:
            yield as_batch(src, dst)

    def as_batch(src: list[np.ndarray], dst: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["src", "dst"])

    return rows.mapInArrow(tidy(run), "src long, dst long").distinct()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (sig, lo, hi) after the other."""
    left: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        left = now if left is None else pa.concat_tables([left, now])
        keys = np.stack([left.column(c).to_numpy() for c in ("sig", "lo", "hi")])
        cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield left.slice(a, b - a)
        left = left.slice(cut[-1])
    if left is not None and len(left):
        yield left


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst) of the pairs whose sets are similar; the join on a much used partner is one that Spark can split."""
    left = pairs.join(sets.select(F.col("doc_id").alias("src"), F.col("items").alias("x")), "src")
    both = left.join(sets.select(F.col("doc_id").alias("dst"), F.col("items").alias("y")), "dst").select("src", "dst", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
                ok.append(bool(len(a)) and similar(int((b[at] == a).sum()), len(a), len(b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(ok, type=pa.bool_()))

    return both.mapInArrow(tidy(run), "src long, dst long")


def _labels(groups: DataFrame, links: DataFrame | None) -> DataFrame:
    """``groups`` (sig, doc_id) with the component of each document, without groups that lie in one component."""
    if links is None:
        marked = groups.withColumn("comp", F.col("doc_id"))
    else:
        found = connected_components(links).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "found")
        marked = groups.join(found, "doc_id", "left").select("sig", "doc_id", F.coalesce("found", "doc_id").alias("comp"))
    open_ = marked.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    return marked.join(open_, "sig", "left_semi")


def links_between(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n; links: src, dst). Links join every two documents that are similar or lead to one another by links.

    Signatures are dealt into buckets by their leading bits, one for each ``share`` bytes of text; a task holds one bucket at a time.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = min(1 << 30, max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // share)))
    raw = docs.select("doc_id", F.encode("text", "utf-8").alias("raw"))
    scanned = raw.mapInArrow(tidy(_scan(buckets)), _FOUND)
    found = staged(scanned.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_credited), _FOUND).drop("sigs", "bucket"), "shingles")
    meta = found.where(F.col("kind") == _DOCUMENT).select("doc_id", "n", "fp1", "fp2")

    usable = meta.where("doc_id is not null and n > 0")
    classes = staged(usable.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    copies = staged(usable.join(classes.where("rep <> last"), ["fp1", "fp2", "n"]).where("doc_id <> rep").select("doc_id", "rep"), "copies")
    left = staged(_left(found, classes), "left")
    every = staged(raw.join(left, "doc_id", "left_semi").mapInArrow(tidy(_enumerated), _SETS), "sets")
    sets = every.where("up = 0").select("doc_id", "n", "items", "sketch")
    groups = staged(_labels(_groups(every), None).select("sig", "doc_id"), "groups")

    # how often a document shares a signature: the original of many edited copies shares more than any copy
    size = groups.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    degree = groups.join(size, "sig").groupBy("doc_id").agg(F.sum("size").alias("degree"))
    ranked = staged(groups.join(degree, "doc_id").select("sig", "doc_id", "degree"), "ranked")
    links: DataFrame | None = None
    tested: DataFrame | None = None
    before = 0
    for turn in range(ROUNDS + 1):
        open_ = staged(_labels(groups, links), "open")
        n = open_.count()
        if not n:
            break
        last = turn == ROUNDS or bool(turn) and n > (1 - WORTH) * before
        before = n
        if last:
            pairs = _possible(open_, sets.select("doc_id", "n", "sketch"))
        else:
            with_degree = open_.join(ranked, ["sig", "doc_id"])
            best = with_degree.groupBy("sig").agg(F.max_by(F.struct("doc_id", "comp"), F.struct("degree", -F.col("doc_id"))).alias("best"))
            met = open_.join(best, "sig").where("comp <> best.comp").groupBy("doc_id", F.col("best.doc_id").alias("hub")).agg(F.count(F.lit(1)).alias("times"))
            pairs = met.select(F.col("doc_id").alias("src"), F.col("hub").alias("dst"), "times")
        if tested is not None:
            both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
            pairs = pairs.join(tested.select(F.inline(both)), ["src", "dst"], "left_anti")
        if not last:
            pairs = pairs.groupBy("src").agg(F.max_by("dst", F.struct("times", -F.col("dst"))).alias("dst"))
        pairs = staged(pairs, "pairs")
        now = staged(_linked(pairs, sets), "links")
        links = now if links is None else links.unionByName(now)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if last:
            break
    equal = copies.select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    return meta.select("doc_id", "n"), equal if links is None else equal.unionByName(links)


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; ids are integers.

    Documents link when 100 * intersection >= 80 * union of their sets of 5-word shingles; component_id is the least id that can be reached by
    links, itself included. Null and empty texts have no shingles and link with nothing. Rows of one id are one
    document with several texts and share its component. A row without id has component null. Texts
    are taken whole; an empty table gives an empty result; other columns are not looked at.
    """
    meta, links = links_between(docs, id_col, text_col, share)
    found = connected_components(links).withColumnRenamed("node", "doc_id")
    out = meta.join(found, "doc_id", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(documents(spark, sf_dir))
