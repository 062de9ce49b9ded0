"""Operator 4: benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts and documents are normalised alike: A-Z lower-cased, words are runs of ASCII
letters, digits and any non-ASCII character. Ten consecutive words of an item are a window; an
item of fewer words, but at least one, is a window as a whole. All windows, as words between
single blanks, go into one automaton, and each normalised text is scanned once. Ends of matches
are mapped back to word numbers, and these to code point offsets of the original text.

The automaton is bounded by ``MAX_PATTERN_BYTES`` of windows: it takes some 45 bytes of memory for
each of them, 180 MB and three seconds at the bound, and a worker builds it once for all its
tasks. A larger benchmark is read in portions of that size, one automaton each, and the documents
pass through them in turn, hits carried along: more scans, same rows, no shuffle either way.

Defined cases: a null text has no words; a text is scanned whole, however long; an empty table
gives an empty result; extra columns are ignored by ``scan`` and kept by ``drop_contaminated``,
whatever their names; items with a null text or without words have no window,
and items with a null item_id are skipped; items that share an id count once; rows that repeat a
doc_id are scanned each for itself; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.names import free_prefix
from tidemark.session import table

WINDOW = 10
MAX_PATTERN_BYTES = 4 << 20
#: Lower case, and a blank for every ASCII character that is in no word.
NORMAL = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def windows(text: bytes | None, width: int = WINDOW) -> set[bytes]:
    words = normal_words(text)
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def portions(benchmark: DataFrame, width: int, max_bytes: int) -> Iterator[dict[bytes, list[str]]]:
    """Window -> item ids, in portions of bounded size; rows come to the driver one by one."""
    part: dict[bytes, list[str]] = {}
    held = 0
    for item, text in benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        for w in windows(bytes(text) if text is not None else None, width):
            owners = part.setdefault(w, [])
            if item not in owners:
                owners.append(item)
            held += len(w) + len(item)
        if held >= max_bytes:
            yield part
            part, held = {}, 0
    yield part


def build(part: dict[bytes, list[str]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, items in part.items():
        a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, items))
    a.make_automaton()
    return a


_built: dict[int, ahocorasick.Automaton] = {}
_numbers = count()  # of the portions of an application; the workers know them by these


def built(number: int, shared) -> ahocorasick.Automaton:
    """The automaton of a portion, kept for the worker's next tasks; the one before it goes."""
    if number not in _built:
        _built.clear()
        _built[number] = build(shared.value)
    return _built[number]


def hits(a: ahocorasick.Automaton, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
    """(first word, end word, items) of every occurrence of a window."""
    s = f" {b' '.join(words).decode('latin-1')} "
    found = list(a.iter(s)) if words and len(a) else []
    if not found:
        return []
    blanks = np.flatnonzero(np.frombuffer(s.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(blanks, [e for e, _ in found]).tolist()
    return [(e - n, e, items) for e, (_, (n, items)) in zip(ends, found, strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


HIT = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("items", pa.list_(pa.string()))])


def _scan(shared, number: int, add: bool, name: str):
    """A mapInArrow function: the last column is replaced by the array of hits."""

    def run(batches):
        a = built(number, shared)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            now = [[{"first": f, "end": e, "items": i} for f, e, i in hits(a, normal_words(t))] for t in texts]
            if add:
                now = [x + y for x, y in zip(b.column(b.num_columns - 1).to_pylist(), now, strict=True)]
                b = b.select(range(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(now, pa.list_(HIT))], names=[*b.schema.names, name])

    return run


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, width: int = WINDOW, max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """``docs`` plus ``name``: all occurrences of windows, in word numbers."""
    kind = f"`{name}` array<struct<first:bigint,end:bigint,items:array<string>>>"
    out = docs
    for n, part in enumerate(portions(benchmark, width, max_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(part)  # at most max_bytes and one item
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), kind])
        out = out.mapInArrow(_scan(shared, next(_numbers), n > 0, name), schema)
    return out


def _report(spans: bool):
    def run(batches):
        for b in batches:
            rows = {k: [] for k in ("n_words", "n_hit", "items", *(("spans",) if spans else ()))}
            for text, found in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = merged([(h["first"], h["end"]) for h in found])
                rows["n_words"].append(len(normal_words(text)))
                rows["n_hit"].append(sum(e - f for f, e in words))
                rows["items"].append(sorted({i for h in found for i in h["items"]}))
                if spans:
                    at = [m.span() for m in WORD.finditer(text.decode())] if words else []
                    rows["spans"].append([{"start": at[f][0], "end": at[e - 1][1]} for f, e in words])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": span}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kinds[k]) for k, v in rows.items())], names=["doc_id", *rows])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_bytes: int = MAX_PATTERN_BYTES, spans: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans)`` for every row of ``docs(doc_id, text, ...)``.

    ``items``: ids of the items that occur, sorted as strings. ``spans``, if wanted: merged hit
    passages as code point offsets of the original text, end exclusive.
    """
    found = with_hits(docs.select("doc_id", "text"), benchmark, "hits", width, max_bytes)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_hit bigint, items array<string>"
    return found.mapInArrow(_report(spans), schema + ", spans array<struct<start:bigint,end:bigint>>" * spans)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs."""
    name = free_prefix(docs, "_d_hits")
    found = with_hits(docs, benchmark, name, width, max_bytes).where(F.size(name) == 0)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op4_decontaminate": op4_decontaminate}
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op4_decontaminate": f"""
    WITH b AS (SELECT item_id, {_WORDS.format("text")} w FROM benchmark WHERE text IS NOT NULL),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') win
           FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM b WHERE len(w) > 0)),
    d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) w FROM documents),
    dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') win
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
    words AS (SELECT doc_id, count(DISTINCT k) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) k FROM hit) GROUP BY 1),
    items AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) s
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item_id FROM hit) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
           sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
