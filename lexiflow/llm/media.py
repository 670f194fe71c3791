"""Edited and cropped copies in a column of images, by local descriptors.

Corners are found at several scales; each gets an orientation from the centroid of its surroundings and a string of binary tests turned
by it. Descriptors meet in Hamming tables, one for each of their 32-bit parts. One corner alone tells little, and tables of single parts fill
with chance meetings that grow with the square of the images; so a table's key is a corner's part together with that of a neighbouring corner and the
coarse turn, direction and distance between the two. Images that share a key are candidates. A candidate pair is verified by matching
descriptors by Hamming distance and counting how many matches agree on one scale, turn and shift.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, staged, staged_all, tidy
from .components import connected_components
from .shingles import mixed

#: Scales, and the strongest corners that are described at each in a picture of :data:`AREA` pixels; larger ones have more, as their sides grow.
SCALES, CORNERS, AREA = (1.0, 0.866, 0.75, 0.65, 0.5625, 0.487), (24, 16, 14, 12, 10, 8), 64 * 64
#: Neighbours that a corner is paired with, how far they are apart at least in pixels of the coarser one's scale, and the steps of turn, direction and distance in a key.
NEIGHBOURS, APART, TURNS, STEP = 2, 7.0, 16, 1.25
#: Radius of the surroundings of a corner, the number of binary tests, and of tables, each of 32 of them.
RADIUS, TESTS, TABLES = 7, 128, 3
#: Bits by which matching descriptors may differ; matches that have to agree on the geometry, one in so many of the points if that is more; and cells of so
#: many pixels that they have to stand in, since one corner is found at several scales.
BITS, AGREEING, ONE_IN, CELLS, CELL = 12, 6, 20, 5, 4.0
#: Pixels by which an agreeing match may be off, per unit of scale.
OFF = 2.5
#: Rounds of verification, hubs that an image is tested against in a round, and table entries that it must share with one.
ROUNDS, HUBS, SHARED = 5, 2, 2
#: Images of :data:`AREA` pixels that are described together.
BLOCK = 128
#: Members of a table entry that are paired at once in the last pass, at most twice as many in a block; and pairs that go on together.
MEMBERS, PAIRS = 2048, 100_000
#: Keys that are dealt out at once, and pairs that the points of their pictures are shipped for at once: what is on disk for either is bounded by these, or by the points of all pictures.
KEYS_AT_ONCE, PAIRS_AT_ONCE = 40_000_000, 250_000

_rng = np.random.Generator(np.random.PCG64(7))
_PATTERN = np.clip(_rng.normal(0, RADIUS / 2.2, (TESTS, 4)), -RADIUS * 0.7, RADIUS * 0.7)
_SIDE = np.arange(-RADIUS, RADIUS + 1)
_DISC = ((_SIDE[:, None] ** 2 + _SIDE[None, :] ** 2) <= RADIUS * RADIUS).astype(np.float32)


def decode(raw: bytes | None) -> np.ndarray | None:
    """The grey values of a binary netpbm image (P5, or P6 as the mean of its colours); None for what is none."""
    m = re.match(rb"(P[56])(?:\s+#[^\n]*)*\s+(\d+)\s+(\d+)\s+(\d+)\s", raw or b"")
    if not m or int(m[4]) != 255 or int(m[2]) < 1 or int(m[3]) < 1:
        return None
    width, height, colours = int(m[2]), int(m[3]), 1 if m[1] == b"P5" else 3
    data = np.frombuffer(raw, dtype=np.uint8, offset=m.end())
    if len(data) < width * height * colours:
        return None
    return data[: width * height * colours].reshape(height, width, colours).mean(axis=2).astype(np.float32)


def encode(grey: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.clip(grey, 0, 255).astype(np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of radius r; the edges repeat."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        total = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
        hi, lo = [slice(None)] * 3, [slice(None)] * 3
        hi[axis], lo[axis] = slice(2 * r + 1, None), slice(None, -2 * r - 1)
        x = ((total[tuple(hi)] - total[tuple(lo)]) / (2 * r + 1)).astype(np.float32)
    return x


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    h, w = (max(1, round(n * scale)) for n in x.shape[1:])
    ys, xs = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(np.floor(ys), 0, x.shape[1] - 2).astype(int), np.clip(np.floor(xs), 0, x.shape[2] - 2).astype(int)
    fy, fx = np.clip(ys - y0, 0, 1).astype(np.float32)[:, None], np.clip(xs - x0, 0, 1).astype(np.float32)[None, :]
    at = lambda a, b: x[:, y0[:, None] + a, x0[None, :] + b]
    return (at(0, 0) * (1 - fy) * (1 - fx) + at(0, 1) * (1 - fy) * fx + at(1, 0) * fy * (1 - fx) + at(1, 1) * fy * fx).astype(np.float32)


def _between(x: np.ndarray, who: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Values of the pictures ``who`` at places between pixels."""
    h, w = x.shape[1:]
    y0, x0 = np.floor(ys).astype(np.int64), np.floor(xs).astype(np.int64)
    fy, fx = (ys - y0).astype(np.float32), (xs - x0).astype(np.float32)
    flat, at = x.reshape(-1), (who * h + y0) * w + x0
    return (flat[at] * (1 - fx) + flat[at + 1] * fx) * (1 - fy) + (flat[at + w] * (1 - fx) + flat[at + w + 1] * fx) * fy


def _top(before: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where a parabola through three values has its top, from the middle one and at most half a step away."""
    bend = before.astype(np.float64) + after - 2.0 * here
    return np.clip(np.where(bend < 0, (before.astype(np.float64) - after) / (2 * np.where(bend < 0, bend, 1)), 0), -0.5, 0.5)


def describe_stack(stack: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each image of one size: (points: x, y, scale, angle as float32; tests: 16 bytes for each point).

    Corners are placed, and their surroundings read, between pixels: with whole pixels a turn by a few degrees changes too many tests.
    """
    n = len(stack)
    points: list[list[np.ndarray]] = [[] for _ in range(n)]
    tests: list[list[np.ndarray]] = [[] for _ in range(n)]
    edge = RADIUS + 2
    for scale, most in zip(SCALES, CORNERS, strict=True):
        x = _box(_resize(stack, scale), 1)
        h, w = x.shape[1:]
        if min(h, w) < 2 * edge + 3:
            continue
        gx, gy = np.gradient(x, axis=2), np.gradient(x, axis=1)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        around = np.pad(response, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
        peak = response > 1e-3
        for dy in range(3):
            for dx in range(3):
                if (dy, dx) != (1, 1):
                    peak &= response >= around[:, dy : dy + h, dx : dx + w]
        inside = np.zeros((h, w), dtype=bool)
        inside[edge : h - edge, edge : w - edge] = True
        strength = np.where(peak & inside, response, -np.inf).reshape(n, -1)
        k = min(round(most * max(1.0, stack.shape[1] * stack.shape[2] / AREA) ** 0.5), strength.shape[1])
        best = np.argsort(-strength, axis=1, kind="stable")[:, :k]
        found = np.isfinite(np.take_along_axis(strength, best, axis=1))
        ys, xs = best // w, best % w
        who = np.arange(n)[:, None]
        row, col = np.clip(ys, 1, h - 2), np.clip(xs, 1, w - 2)
        yf = ys + _top(response[who, row - 1, col], response[who, row, col], response[who, row + 1, col])
        xf = xs + _top(response[who, row, col - 1], response[who, row, col], response[who, row, col + 1])
        yf, xf = np.where(found, yf, edge), np.where(found, xf, edge)
        patch = _between(x, who[:, :, None, None], yf[:, :, None, None] + _SIDE[:, None], xf[:, :, None, None] + _SIDE[None, :]) * _DISC
        angle = np.arctan2((patch * _SIDE[:, None]).sum(axis=(2, 3)), (patch * _SIDE[None, :]).sum(axis=(2, 3)))
        cos, sin = np.cos(angle)[:, :, None], np.sin(angle)[:, :, None]
        read = lambda a, b: _between(x, who[:, :, None], yf[:, :, None] + sin * a + cos * b, xf[:, :, None] + cos * a - sin * b)  # noqa: E731, B023
        bits = np.packbits(read(_PATTERN[:, 0], _PATTERN[:, 1]) < read(_PATTERN[:, 2], _PATTERN[:, 3]), axis=2)
        place = np.stack([(xf + 0.5) / scale, (yf + 0.5) / scale, np.full(xf.shape, 1 / scale), angle], axis=2).astype(np.float32)
        for i in range(n):
            points[i].append(place[i][found[i]])
            tests[i].append(bits[i][found[i]])
    none = np.zeros((0, 4), np.float32), np.zeros((0, TESTS // 8), np.uint8)
    return [(np.concatenate([none[0], *p]), np.concatenate([none[1], *t])) for p, t in zip(points, tests, strict=True)]


def describe(images: list[np.ndarray | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Descriptors of images of any sizes; images of equal size are worked on together."""
    out = [(np.zeros((0, 4), np.float32), np.zeros((0, TESTS // 8), np.uint8))] * len(images)
    shapes: dict[tuple[int, ...], list[int]] = {}
    for i, x in enumerate(images):
        if x is not None:
            shapes.setdefault(x.shape, []).append(i)
    for shape, which in shapes.items():
        block = max(1, BLOCK * AREA // (shape[0] * shape[1]))
        for begin in range(0, len(which), block):
            part = which[begin : begin + block]
            for i, found in zip(part, describe_stack(np.stack([images[i] for i in part])), strict=True):
                out[i] = found
    return out


def keys(points: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """The distinct keys of an image in the Hamming tables: for each corner, each of its nearest neighbours and each table's 32 tests.

    Of the two corners the one with the lesser part comes first, so it does not matter which is the other's neighbour.
    """
    if len(points) < 2:
        return np.zeros(0, dtype=np.int64)
    place = points[:, 0].astype(np.float64) + 1j * points[:, 1]
    away, size = np.abs(place[:, None] - place[None, :]), points[:, 2].astype(np.float64)
    beside = np.where(away < APART * np.maximum(size[:, None], size[None, :]), np.inf, away)
    near = np.argsort(beside, axis=1, kind="stable")[:, :NEIGHBOURS]
    i, j = np.repeat(np.arange(len(points)), near.shape[1]), near.ravel()
    known = np.isfinite(beside[i, j])
    i, j = i[known], j[known]
    words = np.ascontiguousarray(tests).view(np.uint32).astype(np.uint64)
    angle = points[:, 3].astype(np.float64)
    out = []
    with np.errstate(over="ignore"):
        for table in range(TABLES):
            a, b = np.where(words[i, table] <= words[j, table], (i, j), (j, i))
            turn = np.floor((angle[b] - angle[a]) / (2 * np.pi) % 1 * TURNS)
            way = np.floor((np.angle(place[b] - place[a]) - angle[a]) / (2 * np.pi) % 1 * TURNS)
            far = np.floor(np.log(away[a, b] / size[a]) / np.log(STEP))
            level = np.rint(8 * np.log(size[b] / size[a]))
            geometry = ((turn * 64 + way) * 128 + (far + 64)) * 128 + (level + 64)
            out.append(mixed(mixed(words[a, table] << np.uint64(32) | words[b, table]) + mixed(geometry.astype(np.int64).astype(np.uint64) * np.uint64(8) + np.uint64(table))))
    return np.unique(np.concatenate(out).view(np.int64))


def agree(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The greatest number of descriptor matches that fit one scale, turn and shift; 0 if they are too few for the points or stand in too few cells."""
    (pa_, ta), (pb, tb) = a, b
    if not len(pa_) or not len(pb):
        return 0
    apart = np.zeros((len(ta), len(tb)), np.uint8)  # at most 128
    for x, y in zip(np.ascontiguousarray(ta).view(np.uint64).T, np.ascontiguousarray(tb).view(np.uint64).T, strict=True):
        apart += np.bitwise_count(x[:, None] ^ y[None, :])
    i = np.arange(len(pa_))
    j = apart.argmin(axis=1)
    ok = (apart[i, j] <= BITS) & (apart[:, j].argmin(axis=0) == i)
    p, q = pa_[i[ok]].astype(np.float64), pb[j[ok]].astype(np.float64)
    if len(p) < AGREEING:
        return 0
    zoom, turn = q[:, 2] / p[:, 2], q[:, 3] - p[:, 3]
    move = zoom * np.exp(1j * turn)
    zp, zq = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    shift = zq - move * zp
    off = np.abs(move[:, None] * zp[None, :] + shift[:, None] - zq[None, :])
    same = (np.abs(np.log(zoom[:, None] / zoom[None, :])) < 0.4) & (np.cos(turn[:, None] - turn[None, :]) > 0.85)
    fits = (off <= OFF * np.maximum(zoom, 1)[:, None] * 2) & same
    best = fits[fits.sum(axis=1).argmax()]
    cells = np.unique(np.floor(pa_[i[ok]][best, :2] / CELL), axis=0)
    return int(best.sum()) if len(cells) >= CELLS and ONE_IN * best.sum() >= min(len(pa_), len(pb)) else 0


def _points(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(raw, dtype=np.float32, count=4 * n).reshape(n, 4), np.frombuffer(raw, dtype=np.uint8, offset=16 * n).reshape(n, TESTS // 8)


def descriptors(media: DataFrame, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """(media_id, digest, n_points, points binary, parts array<long>) for every row; parts are the :func:`keys` in the Hamming tables."""
    bounded_batches(media.sparkSession)
    rows = media.select(F.col(id_col).cast("long").alias("media_id"), F.sha2(image_col, 256).alias("digest"), F.col(image_col).alias("image"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4 * BLOCK):
                batch = whole.slice(begin, 4 * BLOCK)
                found = describe([decode(x.as_py()) for x in batch.column(2)])
                parts = [keys(p, t) for p, t in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(p) for p, _ in found], type=pa.int64()), pa.array([p.tobytes() + t.tobytes() for p, t in found], type=pa.binary()), pa.array(parts, type=pa.list_(pa.int64()))],
                    names=["media_id", "digest", "n_points", "points", "parts"],
                )

    return rows.mapInArrow(tidy(run), "media_id long, digest string, n_points long, points binary, parts array<long>")


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    side = lambda s: found.select(F.col("media_id").alias(s), F.col("n_points").alias(f"{s}_n"), F.col("points").alias(f"{s}_points"))
    both = pairs.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "src_n", "src_points", "dst_n", "dst_points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.to_pydict()
            ok = [agree(_points(a, n), _points(b, m)) >= AGREEING for n, a, m, b in zip(r["src_n"], r["src_points"], r["dst_n"], r["dst_points"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(ok, type=pa.bool_()))

    return both.mapInArrow(tidy(run), "src long, dst long").distinct()


def _open(entries: DataFrame, links: DataFrame) -> DataFrame:
    """(part, media_id, comp): the entries whose members are in different components by ``links``."""
    comp = connected_components(links).withColumnRenamed("node", "media_id").withColumnRenamed("component", "found")
    marked = staged(entries.select("part", "media_id").join(comp, "media_id", "left").select("part", "media_id", F.coalesce("found", "media_id").alias("comp")), "marked")
    apart = marked.groupBy("part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("part", "size")
    return marked.join(apart, "part")


def _possible(open_: DataFrame, slices: int = 1, k: int = 0) -> DataFrame:
    """(src, dst): all pairs of an entry's members that are in different components; of ``slices`` shares of the work, the one numbered ``k``.

    Large entries are cut into chunks that meet two by two, so neither memory nor time of a task depends on the size of an entry.
    """
    rows = open_.withColumn("chunks", F.ceil(F.col("size") / MEMBERS).cast("int")).withColumn("c", F.pmod(F.xxhash64("media_id"), "chunks").cast("int"))
    rows = rows.select("part", "media_id", "comp", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("x"))
    rows = rows.select("part", F.least("c", "x").alias("lo"), F.greatest("c", "x").alias("hi"), "c", "media_id", "comp")
    rows = rows.where(F.pmod(F.xxhash64("part", "lo", "hi"), F.lit(slices)) == k)
    rows = rows.repartition("part", "lo", "hi").sortWithinPartitions("part", "lo", "hi")

    def of(ids: np.ndarray, comps: np.ndarray, c: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            j = j[(comps[j] != comps[i]) & ((lo == hi) | (c[j] != c[i]))]  # those of one chunk meet where it meets itself
            if len(j):
                yield np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, src, dst, found = None, [], [], 0

        def blocks() -> Iterator[np.ndarray]:
            nonlocal left
            for batch in batches:
                now = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(6)])
                left = now if left is None else np.concatenate([left, now], axis=1)
                cut = [0, *(np.flatnonzero((left[:3, 1:] != left[:3, :-1]).any(axis=0)) + 1).tolist()]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    yield left[:, a:b]
                left = left[:, cut[-1] :]
            if left is not None and left.shape[1]:
                yield left

        for block in blocks():
            for a, b in of(block[4], block[5], block[3], int(block[1, 0]), int(block[2, 0])):
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


def _slices(total: DataFrame, most: int) -> int:
    """How many shares of at most about ``most`` rows there are in ``total``, a table of one number."""
    return max(1, -(-int(total.first()[0] or 0) // most))


def find_copies(media: DataFrame, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """(id, n_points, component_id) for every row of ``media``; ids are integers, component_id is the least id among the copies.

    Equal images form a class and are represented by their least id. In every round each representative is tested against the best connected
    members of its table entries that are in another component; rounds end when none adds a link. A last pass tests all pairs
    that share an entry, be it one only, and are still in different components, so components are those of all verified pairs
    with a common entry. Rounds are linear in the entries and leave that pass less to do; it is not linear in time. Its disk is bounded: pairs are made, joined with their points
    and verified a share at a time, and what a share shuffles is deleted before the next.
    Null, empty and undecodable images have no points and, unless equal, no copies; null and empty ones have none at all. A row without id has
    component null; rows of one id are one picture in several versions, linked where any version is, and share a component. Equal images are
    told by SHA-256. Pictures of any size are read whole, few at a time if they are large. An empty table gives an empty result; other columns are not looked at.
    """
    found = staged(descriptors(media.select(id_col, image_col), id_col, image_col), "descriptors")
    usable = found.where("media_id is not null and n_points > 0")
    classes = staged(usable.groupBy("digest").agg(F.min("media_id").alias("rep"), F.max("media_id").alias("last"), F.count(F.lit(1)).alias("times")), "classes")
    copies = staged(usable.join(classes.where("rep <> last"), "digest").where("media_id <> rep").select("media_id", "rep").distinct(), "copies")
    # most images are the only one of their class and stay where they are; the others are a written table, so Spark broadcasts their digests only while they are few
    several = staged(classes.where("times > 1"), "several")
    kept = ["media_id", "digest", "n_points", "points", "parts"]
    firsts = usable.join(several, "digest").where("media_id = rep").select(*kept).dropDuplicates(["media_id", "digest"])
    chosen = usable.select(*kept).join(several, "digest", "left_anti").unionByName(staged(firsts, "representatives"))
    # one shuffle by key for the count and its rows, some keys at a time; an image has a key once, so no key has more than a small part of the rows. Most keys are in one image only
    slices = _slices(chosen.agg(F.sum(F.size("parts"))), KEYS_AT_ONCE)
    every = chosen.select("media_id", F.explode("parts").alias("part"))
    size = F.count(F.lit(1)).over(Window.partitionBy("part"))
    entries = staged_all((every.where(F.pmod("part", F.lit(slices)) == k).withColumn("size", size).where("size > 1") for k in range(slices)), "entries")
    # from here on only the points are needed; what has the keys as well is deleted
    ids, pictures = staged(found.select("media_id", "n_points"), "ids"), staged(chosen.select("media_id", "n_points", "points"), "pictures")
    discard(found)
    many, before = max(PAIRS_AT_ONCE, pictures.count()), entries
    degree = entries.groupBy("media_id").agg(F.sum("size").alias("degree"))
    entries = staged(entries.join(degree, "media_id").select("part", "media_id", "degree"), "entries")
    discard(before)
    links = copies.select(F.col("media_id").alias("src"), F.col("rep").alias("dst"))
    tested: DataFrame | None = None
    for _ in range(ROUNDS):
        comp = connected_components(links).withColumnRenamed("node", "media_id")
        marked = staged(entries.join(comp, "media_id", "left").select("part", "media_id", "degree", F.coalesce("component", "media_id").alias("comp")), "marked")
        best = marked.groupBy("part").agg(F.max_by(F.struct("media_id", "comp"), F.struct("degree", -F.col("media_id"))).alias("best"))
        met = marked.join(best, "part").where("comp <> best.comp").groupBy(F.col("media_id").alias("src"), F.col("best.media_id").alias("dst")).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= SHARED)
        if tested is not None:
            met = met.join(tested.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))), ["src", "dst"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("times"), "dst"))
        pairs = staged(met.withColumn("k", rank).where(F.col("k") <= HUBS).select("src", "dst"), "pairs")
        discard(marked)
        slices = _slices(pairs.agg(F.count(F.lit(1))), many)
        now = staged_all((_verified(pairs.where(F.pmod(F.xxhash64("src"), F.lit(slices)) == k), pictures) for k in range(slices)), "links")
        if now.isEmpty():
            break
        links, tested = links.unionByName(now), pairs if tested is None else tested.unionByName(pairs)
    open_ = staged(_open(entries, links), "open")
    # an entry has half its size in pairs for each of its rows
    slices = _slices(open_.agg(F.sum((F.col("size") - 1) / 2)), many)
    known = None if tested is None else staged(tested.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "tested")
    left = (_possible(open_, slices, k) for k in range(slices))
    if known is not None:
        left = (pairs.join(known, ["src", "dst"], "left_anti") for pairs in left)
    links = links.unionByName(staged_all((_verified(pairs, pictures) for pairs in left), "links"))
    comp = connected_components(links).withColumnRenamed("node", "media_id")
    out = ids.join(comp, "media_id", "left")
    return out.select(F.col("media_id").alias(id_col), "n_points", F.coalesce("component", "media_id").alias("component_id"))


def _basis(side: int, count: int) -> np.ndarray:
    """``count`` waves of different direction and length; a vector's values are their strengths."""
    steps = (np.arange(side) + 0.5) / side
    most = max(14, int(np.ceil(np.sqrt(count))) + 1)
    waves = [(u, v) for u in range(1, most) for v in range(1, most)]
    chosen = np.random.Generator(np.random.PCG64(5)).permutation(len(waves))[:count]
    return np.stack([np.outer(np.cos(np.pi * waves[k][0] * steps), np.cos(np.pi * waves[k][1] * steps)).ravel() for k in chosen]).astype(np.float32)


def render(embeddings: DataFrame, side: int = 64) -> DataFrame:
    """(media_id, image): a picture of each vector, all values of it, and of every tenth id also a cropped and darkened copy with id -1 - vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waves: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, images = [], []
            for id_, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if id_ is None or not values or any(v is None for v in values):
                    continue
                if len(values) not in waves:
                    waves[len(values)] = _basis(side, len(values))
                grey = (np.array(values, dtype=np.float32) @ waves[len(values)]).reshape(side, side)
                grey = 128 + 50 * (grey - grey.mean()) / (grey.std() + 1e-6)
                ids.append(id_)
                images.append(encode(grey))
                if id_ % 10 == 0:
                    ids.append(-1 - id_)
                    images.append(encode(0.8 * np.clip(grey, 0, 255)[4:-6, 6:-3] + 12))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(images, type=pa.binary())], names=["media_id", "image"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(tidy(run), "media_id long, image binary")


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(render(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
