"""Operator 10: WARC archives as seekable Zstandard bundles.

Every page becomes a WARC/1.1 record with its HTML in UTF-8 as payload (null: empty). Of records
with equal payloads of at least ``min_revisit`` bytes, that with the smallest page_id is the
response, the others are revisits that refer to it and carry no payload. Equal means equal in
SHA-256 and length; the digest written is the usual base32 SHA-1.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES`` and frames into
bundles of about ``BUNDLE_BYTES``. A bundle ends with a seek table in the public seekable format:
a skippable frame of (compressed size, decompressed size) for each frame, the number of frames, a
descriptor and a magic number. An index maps each record to its bundle, frame, offset inside the
decompressed frame and length, so one record is read by decompressing one frame.

Bundles are rows of a written table (``bundle, content``) in the shared folder, as the executors
of a cluster share no local files; ``content`` is byte for byte a ``.warc.zst`` file. Pages meet
their response through digests alone; their HTML moves once, to its bundle.

Defined cases: rows that repeat a page_id are records of their own (rows that share both the
smallest id and the payload are all responses); a null
page_id sorts last and is written as an empty id; a null url as ``about:blank``; an empty table
gives no bundle; a bundle without frames has a seek table of zero entries.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise, table

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- records
def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record; a revisit when ``refers_to`` is given. ``X-Payload-Length`` is the full payload's."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{urn(page_id)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{urn(refers_to)}>"]
    body = b"" if refers_to is not None else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, content) of the records in a decompressed frame."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in lines)
        stop = end + 4 + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} has a wrong length")
        yield at, head, data[end + 4 : stop]
        at = stop + 4


# ---------------------------------------------------------------- bundles
def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    start, out, at = len(content) - 9 - n * width, [], 0
    if struct.unpack("<II", content[start - 8 : start]) != (SKIPPABLE_MAGIC, n * width + 9):
        raise ValueError("damaged seek table")
    for i in range(n):
        packed, plain = struct.unpack_from("<II", content, start + i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(content: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=plain)


class Writer:
    """Fills one bundle frame by frame, and keeps its index."""

    def __init__(self):
        self.packed, self.frames, self.index, self.plain, self.size, self.open = [], [], [], [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, page_id, data: bytes) -> None:
        self.index.append((page_id, len(self.frames), self.open, len(data)))
        self.plain.append(data)
        self.open += len(data)
        if self.open >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.plain:
            plain = b"".join(self.plain)
            frame = self.zstd.compress(plain)
            self.packed.append(frame)
            self.frames.append((len(frame), len(plain)))
            self.size += len(frame)
            self.plain, self.open = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        return b"".join([*self.packed, seek_table(self.frames)])


ENTRY = pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
BUNDLE_SCHEMA = "bundle long, content binary, entries array<struct<page_id:bigint,frame:int,offset:bigint,length:bigint>>"


def _bundles(batches):
    task, n, w = TaskContext.get().partitionId() << 32, 0, Writer()

    def flush():
        entries = [dict(zip(("page_id", "frame", "offset", "length"), e, strict=True)) for e in w.index]
        return pa.RecordBatch.from_arrays([pa.array([task + n], pa.int64()), pa.array([w.finish()], pa.binary()), pa.array([entries], pa.list_(ENTRY))], names=["bundle", "content", "entries"])

    for b in batches:
        for page, url, html, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
            w.add(page, record(page, url, html or b"", refers))
            if w.size >= BUNDLE_BYTES:
                yield flush()
                n, w = n + 1, Writer()
    if w.index:
        yield flush()


def assign(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """``(page_id, url, html, refers_to)``: ``refers_to`` is null for responses."""
    d = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    d = d.withColumns({"sha": F.sha2("html", 256), "size": F.octet_length("html")})
    first = d.where(F.col("size") >= min_revisit).groupBy("sha", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first.drop("n"), "first")
    # pages meet their response by digest, without the html; a payload of its own needs no row
    ids = d.select("page_id", "sha", "size").join(first, ["sha", "size"]).where("page_id is null or page_id <> first_id")
    again = materialise(ids.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first_id").alias("refers_to")).distinct(), "again")
    d = d.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    return d.select("page_id", "url", "html", "refers_to")


def write_bundles(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write the archives of ``pages(page_id, url, html)`` and return their table (see module)."""
    return materialise(assign(pages, min_revisit).mapInArrow(_bundles, BUNDLE_SCHEMA), "warc")


def index(bundles: DataFrame) -> DataFrame:
    """``(page_id, bundle, frame, offset, length)`` of every record."""
    return bundles.select("bundle", F.explode("entries").alias("e")).select("e.page_id", "bundle", "e.frame", "e.offset", "e.length")


def _read(batches):
    for b in batches:
        for content in b.column(0):
            data, cols = content.as_py(), {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for frame in read_seek_table(data):
                for _, head, body in parse(read_frame(data, frame)):
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (sha1_base32(body), len(body)) != (digest, size):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    page, refers = head["WARC-Record-ID"][10:-1], head.get("WARC-Refers-To", "<urn:page:>")[10:-1]
                    for k, v in zip(cols, (int(page) if page else None, size, digest, head["WARC-Type"], int(refers) if refers else None), strict=True):
                        cols[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)], names=list(cols))


def read_back(bundles: DataFrame) -> DataFrame:
    """One row per record, from the archives alone; payload digests are checked."""
    return bundles.select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _fetch(batches):
    for b in batches:
        rows = {"page_id": [], "record": []}
        for content, wanted in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            data = content.as_py()
            frames, plain = read_seek_table(data), {}
            for e in wanted:
                f = e["frame"]
                plain = plain if f in plain else {f: read_frame(data, frames[f])}
                rows["page_id"].append(e["page_id"])
                rows["record"].append(plain[f][e["offset"] : e["offset"] + e["length"]])
        yield pa.RecordBatch.from_arrays([pa.array(rows["page_id"], pa.int64()), pa.array(rows["record"], pa.binary())], names=list(rows))


def fetch(bundles: DataFrame, ids: DataFrame) -> DataFrame:
    """``(page_id, record)`` of the records of ``ids(page_id)``; only their frames are decompressed."""
    wanted = index(bundles).join(ids.select("page_id").distinct(), "page_id").groupBy("bundle")
    wanted = wanted.agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length", "page_id"))).alias("wanted"))
    return bundles.select("bundle", "content").join(wanted, "bundle").select("content", "wanted").mapInArrow(_fetch, "page_id long, record binary")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write_bundles(table(spark, sf_dir, "pages")))


QUERIES = {"op10_warc": op10_warc}
SQL = {
    "op10_warc": """
    WITH d AS (SELECT page_id, coalesce(html, '') h, min(page_id) OVER (PARTITION BY coalesce(html, '')) first_id FROM pages),
    s AS (SELECT *, sha1(h) x FROM d)
    SELECT page_id, strlen(h)::BIGINT payload_bytes,
      array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(x, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') payload_digest,
      CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END record_type,
      CASE WHEN page_id <> first_id THEN first_id END refers_to
    FROM s""",
}
