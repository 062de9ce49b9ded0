"""Operator 6: repeated word passages, found by difference-cover anchors.

A window is ``WINDOW`` (35) consecutive words. Words are taken as they are. Every word covered by
a window whose sequence also starts anywhere else in the corpus, the same document included, goes.

Anchors. Positions of a document are covered if they are, modulo ``PERIOD`` (21), in ``COVER``, a
perfect difference set: every difference modulo 21 is one of two of its members. Two equal windows
at i and j therefore have an offset k < 21 at which both i+k and j+k are covered, and the 15 words
from there are in both windows. Only those 15-word runs at covered positions (5 of 21) are hashed
and counted over the corpus. Around each shared anchor the match is then extended: the windows
that hold it are hashed whole and counted in the same way, and those counted twice are removed.

Both counts go by pieces (see ``pieces``): a passage in a third of all documents is sent once a
piece. Anchors are 64-bit hashes, as they only choose what is looked at; equality of windows is
that of 128-bit hashes, two of 64 bits from independent hashes of the words: about n*n/2^129
chance of any false match among n distinct windows.

Defined cases: a null text has no words; shorter documents keep all; rows that are equal, ids
included, are separate starts, so they remove each other; a null doc_id stays null; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.pieces import ANSWER_SCHEMA, ODD, REQUEST_SCHEMA, Piece, answer_all, bucket_count, distinct, make_pieces, mix, pack, pieces_of, requests, unpack, unpack_ints, unpack_sorted
from tidemark.session import materialise, table

WINDOW = 35
#: Bytes of text whose keys one bucket counts.
BUCKET_BYTES = 16 << 20
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
ANCHORS, WINDOWS = 0, 1


def _prefix(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of word * ODD**i, and the inverse powers, both modulo 2**64."""
    powers = np.full(len(words), ODD, np.uint64)
    if len(words):
        powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    back = np.full(len(words), np.uint64(pow(int(ODD), -1, 1 << 64)), np.uint64)
    if len(words):
        back[0] = 1
    return np.concatenate([[np.uint64(0)], np.cumsum(words * powers, dtype=np.uint64)]), np.cumprod(back, dtype=np.uint64)


class Runs:
    """Hashes of runs of words of one piece; a run stays inside its document."""

    def __init__(self, p: Piece, window: int):
        self.p, self.window = p, window
        self.sums, self.back = _prefix(p.words)
        self.more: np.ndarray | None = None
        n = len(p.words)
        self.local = np.arange(n) - np.repeat(p.starts, p.lengths)
        self.left = np.repeat(p.lengths, p.lengths) - self.local  # words from here to the document's end
        self.long = np.repeat(p.lengths >= window, p.lengths)

    def hash(self, at: np.ndarray, width: int) -> np.ndarray:
        return mix((self.sums[at + width] - self.sums[at]) * self.back[at] + np.uint64(width))

    def pair(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of a 128-bit hash."""
        if self.more is None:
            self.more = _prefix(self.p.others)[0]
        return self.hash(at, width), mix((self.more[at + width] - self.more[at]) * self.back[at] + np.uint64(width))

    def anchors(self) -> np.ndarray:
        """Positions of anchors, in documents that have a window at all."""
        covered = np.isin(np.arange(PERIOD), COVER)[self.local % PERIOD]
        return np.flatnonzero(covered & self.long & (self.left >= self.window - PERIOD + 1))

    def windows_around(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of all windows that hold one of these anchors."""
        edge = np.zeros(len(self.local) + 1, np.int64)
        np.add.at(edge, np.maximum(anchors - (PERIOD - 1), anchors - self.local[anchors]), 1)
        np.add.at(edge, anchors + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= self.window))


def _ask_anchors(window: int, buckets: int):
    def run(batches):
        for b in batches:
            for n, p in pieces_of(b):
                r = Runs(p, window)
                yield requests(n, ANCHORS, r.hash(r.anchors(), window - PERIOD + 1), None, buckets)

    return run


def _shared(t: pa.Table) -> pa.Table:
    """For one bucket: which of the keys of each piece are counted at least twice, as bits."""
    keys, counts = ([f(x) for x in t.column(c).to_pylist()] for c, f in (("keys", unpack_sorted), ("counts", lambda x: unpack_ints(x, np.int64))))
    others = None if t.column("others").null_count else np.concatenate([unpack(x, np.uint64) for x in t.column("others").to_pylist()])
    first, where = distinct(np.concatenate(keys), others)
    summed = np.bincount(where, np.concatenate(counts), len(first))
    bits = np.split(summed[where] > 1, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"piece": t.column("piece"), "bucket": t.column("bucket"), "family": t.column("family"), "vals": pa.array([pack(x) for x in bits], pa.binary())})


def _repeated(keys: np.ndarray, others: np.ndarray | None, answers, family: int) -> np.ndarray:
    """Of keys (any order, repeats), which are shared."""
    return answer_all(answers, family, np.bool_)[distinct(keys, others)[1]] if len(keys) else np.zeros(0, bool)


def _near(r: Runs, answers) -> np.ndarray:
    at = r.anchors()
    return r.windows_around(at[_repeated(r.hash(at, r.window - PERIOD + 1), None, answers, ANCHORS)])


def _ask_windows(window: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for n, p in pieces_of(left):
            r = Runs(p, window)
            out.append(requests(n, WINDOWS, *r.pair(_near(r, right), window), buckets))
        return pa.Table.from_batches(out)

    return run


def _remove(window: int, finish):
    """The last step of a piece; ``finish`` makes a column of the kept words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for _, p in pieces_of(left):
            r = Runs(p, window)
            starts = _near(r, right)
            gone = starts[_repeated(*r.pair(starts, window), right, WINDOWS)]
            edge = np.zeros(len(p.words) + 1, np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
            removed, kept = np.zeros(len(p.texts), np.int64), []
            for d, (text, at, n) in enumerate(zip(p.texts, p.starts.tolist(), p.lengths.tolist(), strict=True)):
                words, cut = text.split(), covered[at : at + n]
                if cut.any():
                    removed[d] = cut.sum()
                    words = [words[i] for i in np.flatnonzero(~cut).tolist()]
                kept.append(finish(b" ".join(words)))
            out.append(pa.table({"doc_id": p.id_array(), "n_words": pa.array(p.lengths), "n_removed": pa.array(removed), "kept": pa.array(kept, pa.string())}))
        return pa.concat_tables(out)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, finish=bytes.decode) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: the kept words of every row, joined by blanks.

    ``finish`` turns the kept words (UTF-8) into the string that is returned for them.
    """
    if window < PERIOD:
        raise ValueError(f"windows of under {PERIOD} words need a smaller period")
    pieces = materialise(make_pieces(docs), "pieces")
    buckets = bucket_count(pieces, BUCKET_BYTES)
    asked = pieces.mapInArrow(_ask_anchors(window, buckets), REQUEST_SCHEMA)
    anchors = materialise(asked.groupBy("bucket").applyInArrow(_shared, ANSWER_SCHEMA), "anchors")
    asked = pieces.groupBy("piece").cogroup(anchors.groupBy("piece")).applyInArrow(_ask_windows(window, buckets), REQUEST_SCHEMA)
    windows = materialise(asked.groupBy("bucket").applyInArrow(_shared, ANSWER_SCHEMA), "windows")
    known = anchors.union(windows).groupBy("piece")
    return pieces.groupBy("piece").cogroup(known).applyInArrow(_remove(window, finish), "doc_id long, n_words long, n_removed long, kept string")


def sha256_hex(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), finish=sha256_hex).withColumnRenamed("kept", "kept_sha256")


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
SQL = {
    "op6_substring_dedup": r"""
    WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) ws FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) h FROM (SELECT *, unnest(range(1, len(ws) - 33)) i FROM w WHERE len(ws) >= 35)),
    dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) k FROM win JOIN dup USING (h)),
    word AS (SELECT doc_id, unnest(ws) x, unnest(range(1, len(ws) + 1)) k FROM w),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) s, count(*) n FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
    SELECT doc_id, len(ws)::BIGINT n_words, (len(ws) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(s, '')) kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)""",
}
