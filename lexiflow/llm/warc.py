"""WARC archives with an index that is written first and read by coalesced byte ranges.

Writing: each task fills archives of bounded size, one gzip member for a record, and gives an index row (archive, offset, length, url, digest, ...) for each record. The index
is the commit: a task that runs again writes archives of other names, and what no index row names is not part of the result.

Reading: the index rows wanted are dealt into even ranges of (archive, offset) and sorted. Rows that lie close together become one read; the members are cut out of it,
unpacked and checked against their digest. Whole archives are never read, and no task holds more than one run of records.

Archives stand in any store that pyarrow's file systems reach (``file:``, ``hdfs:``, ``s3:``, ``gs:``), shared by all machines.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shared_folder, staged, tidy

#: Payloads under this many bytes are written again rather than referred to.
LEAST_SHARED = 100
#: Packed bytes after which a task begins another archive.
ARCHIVE = 256 << 20
#: Bytes between two wanted records that are read along rather than skipped; bytes of one read, unless a record is longer.
GAP, RUN = 64 << 10, 8 << 20
#: Packed bytes that one reading task takes, about; the index alone is far too small to tell.
SHARE = 16 << 20
#: Unpacked bytes of records that leave a task together.
BLOCK = 16 << 20
#: Date of records whose table has none.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string"
RECORDS = INDEX + ", sound boolean, payload binary"


class Record(NamedTuple):
    """A parsed record; ``http`` are the header lines of its block, ``payload`` what follows them."""

    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def one_line(value: str) -> str:
    """White space and control characters, which would end a header line or be trimmed, are written in percent."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group(), safe=""), value)


def record_bytes(record_id: str, url: str | None, kind: str, digest: str, size: int, payload: bytes | None, refers_to: str | None, date: str = DATE) -> bytes:
    """A record of WARC 1.1: the block is an HTTP answer, of which a revisit has the header only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {one_line(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(raw: bytes) -> Record:
    """A record from its unpacked bytes; raises ``ValueError`` where it is cut off or none."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    first, headers = _header(head)
    if not sep or not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("the record is cut off")
    block = rest[:size]
    if not headers.get("content-type", "").startswith("application/http"):
        return Record(headers, {}, block)
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, _header(http)[1], payload)


def described(r: Record) -> dict:
    """The columns of :data:`RECORDS` that a record says itself; a revisit's payload is null and its size what the HTTP header says."""
    kind, said = r.headers.get("warc-type"), r.headers.get("warc-payload-digest", "")
    digest = said.removeprefix("sha256:") if said.startswith("sha256:") else None
    full = kind != "revisit"
    found = hashlib.sha256(r.payload).hexdigest() if full else digest
    url, to = r.headers.get("warc-target-uri"), r.headers.get("warc-refers-to")
    return {
        "record_id": r.headers.get("warc-record-id", "").strip("<>"), "url": url, "record_type": kind, "payload_digest": found,
        "payload_bytes": len(r.payload) if full else int(r.http.get("content-length", -1)), "refers_to": to and to.strip("<>"), "sound": digest is None or digest == found, "payload": r.payload if full else None,
    }


def member(raw: bytes, level: int = 6) -> bytes:
    """One gzip member, without a time stamp, so that equal records have equal bytes."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def unpacked(raw: bytes) -> bytes:
    """A record as it was before packing; one that is not packed as it is."""
    return zlib.decompressobj(31).decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    fs, at = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, at


# --- writing ---------------------------------------------------------------------------------------------------------------------------------


def roles(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(id, url, payload, payload_bytes, payload_digest, refers_id): each page with the id of the page whose payload it repeats, else null.

    Of equal payloads of ``least`` bytes or more that of the smallest id is kept, the others refer to it; a null id is after all others, and rows that repeat the smallest
    id repeat its record. Payloads are compared by SHA-256. Sizes and digests alone are grouped, with minima combined before the shuffle; the join back is
    against digests that stand more than once, and can be split where one is frequent.
    """
    known = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    groups = known.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and least_id is not null")
    groups = staged(groups.select(F.col("payload_digest").alias("digest"), "least_id"), "payloads")
    refers = F.when(~F.col("least_id").eqNullSafe(F.col("id")), F.col("least_id"))
    return known.join(groups, known["payload_digest"] == groups["digest"], "left").select("id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_id"))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_SHARED, archive: int = ARCHIVE) -> DataFrame:
    """Write one record for each row of ``pages`` under ``path`` and return the index (:data:`INDEX`), itself a written table.

    The payload is the html in UTF-8, null as empty; pages of any length are written whole. A null URL leaves the header out. Repeated rows are written again; an empty
    table writes no archive. Other columns are not looked at. ``path`` is a folder that all machines share.
    """
    bounded_batches(pages.sparkSession, 200)
    rows = roles(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload")), least)
    rows = rows.select(
        record_id(F.col("id")).alias("record_id"), "url", F.when(F.col("refers_id").isNull(), "response").otherwise("revisit").alias("record_type"), "payload_digest", "payload_bytes",
        F.when(F.col("refers_id").isNotNull(), record_id(F.col("refers_id"))).alias("refers_to"), F.when(F.col("refers_id").isNull(), F.encode("payload", "UTF-8")).alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(path)
        fs.create_dir(folder, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                found = []
                for key, url, kind, digest, size, to, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or offset >= archive:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    packed = member(record_bytes(key, url, kind, digest, size, payload, to))
                    out.write(packed)
                    found.append((f"{path}/{name}", offset, len(packed), key, url, kind, digest, size, to))
                    offset += len(packed)
                yield _batch(found, INDEX)
        finally:
            if out is not None:
                out.close()

    return staged(rows.mapInArrow(tidy(run), INDEX), "warc-index")


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=_KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


# --- the index of archives that others wrote ---------------------------------------------------------------------------------------------------


def members(stream: BinaryIO, piece: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, unpacked bytes) of each record of an archive, packed by record or not at all, read from front to back."""
    held, offset, ended = b"", 0, False

    def more() -> bool:
        nonlocal held, ended
        got = stream.read(piece)
        held, ended = held + got, not got
        return bool(got)

    while held or more():
        if held[:2] == b"\x1f\x8b" or (len(held) < 2 and more() and held[:2] == b"\x1f\x8b"):
            pack, parts, fed = zlib.decompressobj(31), [], held
            length = 0
            while True:
                parts.append(pack.decompress(fed))
                length += len(fed) - len(pack.unused_data)
                if pack.eof:
                    held = pack.unused_data
                    break
                fed = stream.read(piece)
                if not fed:
                    raise ValueError("the archive ends within a record")
            yield offset, length, b"".join(parts)
            offset += length
            continue
        while b"\r\n\r\n" not in held and more():
            pass
        head = held.partition(b"\r\n\r\n")[0]
        first, headers = _header(head)
        if not first.startswith("WARC/"):
            if held.strip():
                raise ValueError(f"no WARC record at {offset}")
            return
        length = len(head) + 4 + int(headers["content-length"]) + 4
        while len(held) < length and more():
            pass
        if len(held) < length - 4:
            raise ValueError("the archive ends within a record")
        yield offset, length, held[:length]
        held, offset = held[length:], offset + length


def index_archives(archives: DataFrame, path_col: str = "path") -> DataFrame:
    """The index (:data:`INDEX`) of archives that stand already, each read once from front to back by one task; payloads are not kept. Null paths are skipped."""
    paths = archives.select(F.col(path_col).alias("path")).where("path is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = store(path)
                found = []
                with fs.open_input_stream(at, compression=None) as stream:
                    for offset, length, raw in members(stream):
                        d = described(parse_record(raw))
                        found.append((path, offset, length, *(d[k] for k in ("record_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"))))
                        if len(found) >= 10_000:
                            yield _batch(found, INDEX)
                            found = []
                yield _batch(found, INDEX)

    return paths.repartition("path").mapInArrow(tidy(run), INDEX)


# --- reading -----------------------------------------------------------------------------------------------------------------------------------


def coalesced(ranges: Iterable[tuple[str, int, int]], gap: int = GAP, run: int = RUN) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(archive, start, end, its ranges) of the reads for sorted (archive, offset, length): neighbours no more than ``gap`` apart together, up to ``run`` bytes."""
    at, start, end, inside = None, 0, 0, []
    for archive, offset, length in ranges:
        if inside and (archive != at or offset > end + gap or max(end, offset + length) - start > run):
            yield at, start, end, inside
            inside = []
        if not inside:
            at, start, end = archive, offset, offset
        end = max(end, offset + length)
        inside.append((offset, length))
    if inside:
        yield at, start, end, inside


def read_records(wanted: DataFrame, payloads: bool = True, gap: int = GAP, run_bytes: int = RUN, share: int = SHARE) -> DataFrame:
    """The records (:data:`RECORDS`) of the index rows ``wanted`` (archive, offset, length; other columns are not looked at).

    Everything but the place comes from the record itself; ``sound`` tells whether the payload has the digest that its record names. With ``payloads`` false the column is null, and
    the bytes stay in the task. There is a task for each ``share`` bytes to read. A row that stands twice is read twice. Rows with a null place are skipped; an empty table gives an empty result.
    """
    places = wanted.where("archive is not null and offset is not null and length is not null").select("archive", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    size = places.agg(F.sum("length")).first()[0] or 0
    ordered = places.repartitionByRange(-(-size // share) or 1, "archive", "offset").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        opened, source, rows, size = None, None, [], 0
        for archive, start, end, inside in coalesced(ranges, gap, run_bytes):
            if archive != opened:
                if source is not None:
                    source.close()
                fs, at = store(archive)
                opened, source = archive, fs.open_input_file(at)
            held = memoryview(source.read_at(end - start, start))
            for offset, length in inside:
                d = described(parse_record(unpacked(bytes(held[offset - start : offset - start + length]))))
                size += len(d["payload"] or b"") if payloads else 0
                rows.append((archive, offset, length, *(d[k] for k in ("record_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "sound")), d["payload"] if payloads else None))
                if size >= BLOCK or len(rows) >= 10_000:
                    yield _batch(rows, RECORDS)
                    rows, size = [], 0
        if source is not None:
            source.close()
        yield _batch(rows, RECORDS)

    return ordered.mapInArrow(tidy(run), RECORDS)


def resolved(records: DataFrame, columns: tuple[str, ...] = ("payload_bytes", "payload_digest")) -> DataFrame:
    """``records`` whose revisits take ``columns`` from the response that they refer to; a revisit of a response that is not among them keeps its own."""
    revisits = records.where("refers_to is not null")
    targets = revisits.select(F.col("refers_to").alias("record_id")).distinct()
    # a response that many refer to is one row of a written table, so that the join to it can be split
    full = staged(records.where("record_type = 'response'").join(targets, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to")).agg(F.first(F.struct(*columns)).alias("full")), "warc-full")
    found = revisits.join(full, "refers_to", "left").select(*[F.coalesce(F.col(f"full.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in records.columns])
    return records.where("refers_to is null").unionByName(found)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = write_archives(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    found = resolved(staged(read_records(index, payloads=False), "warc-read"))
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    sound = F.when(F.col("sound"), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id")).cast("long"))
    return found.select(page(F.col("record_id")).alias("page_id"), sound.alias("payload_bytes"), "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, min(page_id) AS least_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN least_id <> page_id THEN least_id END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""
