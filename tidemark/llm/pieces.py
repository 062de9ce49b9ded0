"""Texts in packed pieces, and counts of keys over all pieces.

A piece holds some thousand consecutive rows (about ``PIECE_BYTES`` of text; a longer document is
a piece of its own), packed with Zstandard and written once: a third of the size of word hashes,
and the texts need not move again. Whatever is asked about the corpus is then asked piece by
piece:

1. each piece sends, for every bucket of the key space, its sorted distinct keys with their local
   counts (so a key shared by a third of all rows is sent once a piece, not once a row);
2. each bucket adds up the counts of a key over all pieces, and
3. answers every piece with values in the order of the keys it sent, which the piece can match by
   making the same keys again.

Nothing passes through the driver, and there are as many buckets as the bytes of the corpus ask
for, so what a task holds does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 8 << 20
PIECE_SCHEMA = "piece long, bytes long, ids binary, sizes binary, texts binary"
LEAST_BUCKETS = 16
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
ODD = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- packing
def pack(a: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack_ints(a: np.ndarray) -> bytes:
    """Whole numbers of any shape, not negative: byte planes apart, and none for high zeros."""
    a = np.ascontiguousarray(a).ravel().astype(np.uint64, copy=False)
    used = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = a.view(np.uint8).reshape(-1, 8)[:, :used].T
    return bytes([used]) + pack(planes)


def unpack_ints(b: bytes, kind) -> np.ndarray:
    used = b[0]
    planes = unpack(b[1:], np.uint8)
    out = np.zeros((planes.size // used, 8), np.uint8)
    out[:, :used] = planes.reshape(used, -1).T
    return out.view(np.uint64).ravel().astype(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences."""
    return pack_ints(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(b, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Numbers(dict):
    """word -> its number in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


# ---------------------------------------------------------------- pieces
def _pieces(size: int):
    def run(batches):
        held, count, n = [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def flush():
            ids, texts = zip(*held, strict=True)
            cols = [pack(np.array(ids, np.int64)), pack_ints(np.array([len(t) for t in texts], np.int64)), pack(np.frombuffer(b"".join(texts), np.uint8), 3)]
            return pa.RecordBatch.from_arrays([pa.array([task + n], pa.int64()), pa.array([count], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], names=["piece", "bytes", "ids", "sizes", "texts"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                t = text or b""
                if held and count + len(t) > size:
                    yield flush()
                    held, count, n = [], 0, n + 1
                held.append((i, t))
                count += len(t)
        if held:
            yield flush()

    return run


def make_pieces(docs: DataFrame, size: int = PIECE_BYTES) -> DataFrame:
    """Pieces of ``docs(doc_id, text, ...)``."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    return rows.mapInArrow(_pieces(size), PIECE_SCHEMA)


def bucket_count(pieces: DataFrame, each: int) -> int:
    """As many buckets as give each about ``each`` bytes of text, and ``LEAST_BUCKETS`` at least."""
    return max(LEAST_BUCKETS, -(-(pieces.agg(F.sum("bytes")).first()[0] or 0) // each))


class Piece:
    """One unpacked piece: ids and texts of its rows, and two independent hashes of all their words."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes):
        self.ids = unpack(ids, np.int64)
        data, to = zstandard.ZstdDecompressor().decompress(texts), np.cumsum(unpack_ints(sizes, np.int64)).tolist()
        self.texts = [data[a:b] for a, b in zip([0, *to], to, strict=False)]
        lengths: list[int] = []

        def lists():
            for t in self.texts:  # the words of one text at a time
                w = t.split()
                lengths.append(len(w))
                yield w

        number = Numbers()
        numbers = np.fromiter(map(number.__getitem__, chain.from_iterable(lists())), np.uint32)
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), np.uint64).reshape(-1, 2)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words, self.others = hashes[numbers, 0], hashes[numbers, 1]

    def id_array(self, at=slice(None)) -> pa.Array:
        return pa.array(self.ids[at], mask=self.ids[at] == NO_ID)


def pieces_of(table) -> Iterator[tuple[int, Piece]]:
    """The pieces in an Arrow table or batch, one at a time."""
    for i in range(table.num_rows):
        piece, *rest = (table.column(c)[i].as_py() for c in ("piece", "ids", "sizes", "texts"))
        yield piece, Piece(*rest)


# ---------------------------------------------------------------- asking and answering
def bounds(buckets: int) -> np.ndarray:
    """The first key of each bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def distinct(keys: np.ndarray, others: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key in order, the number of each key among them).

    With ``others`` a key is the pair of both.
    """
    if others is None:
        _, first, where = np.unique(keys, return_index=True, return_inverse=True)
        return first, where
    order = np.lexsort((others, keys))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (others[order[1:]] != others[order[:-1]])
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(new) - 1
    return order[new], where


def requests(piece: int, family: int, keys: np.ndarray, others: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """Rows ``(bucket, piece, family, keys, others, counts)`` of keys in any order, repeats counted."""
    first, where = distinct(keys, others)
    counts, keys = np.bincount(where, minlength=len(first)), keys[first]
    cut = np.concatenate([[0], np.searchsorted(keys, bounds(buckets)), [len(keys)]])
    at = [i for i in range(buckets) if cut[i] < cut[i + 1]]
    span = [slice(cut[i], cut[i + 1]) for i in at]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(at, pa.int32()), pa.array([piece] * len(at), pa.int64()), pa.array([family] * len(at), pa.int32()),
            pa.array([pack_sorted(keys[s]) for s in span], pa.binary()),
            pa.array([None if others is None else pack(others[first[s]]) for s in span], pa.binary()),
            pa.array([pack_ints(counts[s]) for s in span], pa.binary()),
        ],
        names=["bucket", "piece", "family", "keys", "others", "counts"],
    )


REQUEST_SCHEMA = "bucket int, piece long, family int, keys binary, others binary, counts binary"
ANSWER_SCHEMA = "piece long, bucket int, family int, vals binary"


def answer_all(answers, family: int, kind) -> np.ndarray:
    """The values of one family for a piece, in the order of its sorted distinct keys."""
    got = sorted((b, v) for b, f, v in zip(answers.column("bucket").to_pylist(), answers.column("family").to_pylist(), answers.column("vals").to_pylist(), strict=True) if f == family)
    return np.concatenate([unpack(v, kind) for _, v in got]) if got else np.zeros(0, kind)
