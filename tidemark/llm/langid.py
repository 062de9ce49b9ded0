"""Operator 5: language identification by error-correcting output codes.

Every language gets a codeword of +1/-1 bits: for up to five languages all ways to split them in
two, for more of them the best-separated of some seeded random codes. Each bit has a binary
classifier over hashed byte trigrams (letters lower-cased in ASCII, anything else in ASCII one
blank): its weight for a trigram is the log-odds of the languages with bit +1 against those with
-1, every language counting the same. A text's margin for a bit is its trigrams' summed weight
over the square root of their number, in units of the mean margin in training. The decoder sums,
for each codeword, the logistic loss of its bits, weighted by how often that bit was right for
that language in training; the least loss names the language. The score is the softmax of the
negative losses; a text whose two best codewords are closer than ``AMBIGUOUS`` is flagged.

Training reads text and non-null lang only. It uses a sample of at most about ``TRAIN_ROWS`` rows
a language (a documented parameter; chosen by hash of doc_id), whole texts. What comes to the
driver is one row of ``BUCKETS`` counts a language, one row after the other: half a megabyte a
language, whatever the input's size, and less in the model that is broadcast. Prediction reads
every whole text and nothing else, in blocks, so a very long text takes no more memory.

Defined cases: a null text or one without a letter is ``und`` with score 0, never ambiguous; so is
every text if there is nothing to learn from; with one language learned it is the only answer. Of
codewords with equal loss the language first in order wins; repeated rows are rows like any other;
an empty table gives an empty result; extra columns are ignored, and kept by the pipeline's stage.
"""

from __future__ import annotations

import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

BUCKETS = 1 << 16
TRAIN_ROWS = 4000
AMBIGUOUS = 0.05
SMOOTHING = 0.5
BLOCK = 1 << 17
#: Lower case, and a blank for every ASCII character that is no letter.
NORMAL = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")


def trigrams(text: bytes):
    """Bucket numbers of all byte trigrams, block by block."""
    x = np.frombuffer(b" " + b" ".join(text.translate(NORMAL).split()) + b" ", np.uint8)
    for at in range(0, len(x) - 2, BLOCK):
        y = x[at : at + BLOCK + 2].astype(np.uint32)
        h = (y[:-2] * np.uint32(0x9E3779B1) + y[1:-1] * np.uint32(0x85EBCA77)) ^ (y[2:] * np.uint32(0xC2B2AE3D))
        yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(language, bit) of +1 and -1; no bit is the same for all languages."""
    if n <= 5:
        bits = [(1, *b) for b in product((1, -1), repeat=n - 1) if -1 in b]
        return np.array(bits, np.int8).T.reshape(n, -1)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.int8), (n, width))
        c = c[:, np.abs(c.sum(axis=0, dtype=np.int64)) < n]
        apart = (c.shape[1] - c.astype(np.int32) @ c.T.astype(np.int32)) // 2 + 10**6 * np.eye(n, dtype=np.int64)
        if apart.min() > most:
            best, most = c, apart.min()
    return best


class Model:
    """Languages, codewords, bit classifiers, scales and decoding weights."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs)) if langs else np.zeros((0, 0), np.int8)
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True) if langs else counts
        bits = [np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) for c in self.code.T]
        self.weights = np.ascontiguousarray(np.array(bits, np.float32).T.reshape(BUCKETS, -1))
        self.scale = np.ones(self.code.shape[1])
        self.trust = np.ones(self.code.shape)

    def margins(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for h in trigrams(text):
            total += self.weights[h].sum(axis=0)
            n += len(h)
        return total / np.sqrt(max(n, 1)) / self.scale

    def decode(self, margins: np.ndarray) -> tuple[int, float, float]:
        """(language number, score, gap of the two best) by least weighted loss."""
        loss = (self.trust * np.logaddexp(0, -3 * self.code * margins)).sum(axis=1) / self.trust.sum(axis=1)
        p = np.exp(-4 * (loss - loss.min()))
        p /= p.sum()
        order = np.argsort(loss, kind="stable")
        gap = float(p[order[0]] - p[order[1]]) if len(order) > 1 else 1.0
        return int(order[0]), float(min(1.0, p[order[0]])), gap

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not LETTER.search(text.decode()):
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        k, score, gap = self.decode(self.margins(text))
        return self.langs[k], score, gap < AMBIGUOUS


def _counts(batches):
    seen: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            c = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for h in trigrams(text):
                c += np.bincount(h, minlength=BUCKETS)
        if len(seen) > 64:
            yield _dense(seen)
            seen = {}
    yield _dense(seen)


def _dense(seen: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row a language with all its counts, packed."""
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([zlib.compress(c.tobytes(), 1) for c in seen.values()], pa.binary())], names=["lang", "counts"])


def _of_language(t: pa.Table) -> pa.Table:
    """One language's counts over all tasks; a task gives a row, and reads no more than ``TRAIN_ROWS`` texts in all."""
    total = np.zeros(BUCKETS, np.int64)
    for c in t.column("counts"):
        total += np.frombuffer(zlib.decompress(c.as_py()), np.int64)
    return pa.table({"lang": t.column("lang")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _trials(shared):
    def run(batches):
        m, of = shared.value, {lang: k for k, lang in enumerate(shared.value.langs)}
        for b in batches:
            size = np.zeros(m.code.shape)
            right = np.zeros(m.code.shape)
            n = np.zeros(len(m.langs))
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                k, x = of[lang], m.margins(text)
                n[k] += 1
                size[k] += np.abs(x)
                right[k] += np.sign(x) == m.code[k]
            k, j = np.indices(m.code.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(n[k]), pa.array(size.ravel()), pa.array(right.ravel())], names=["k", "j", "n", "size", "right"]
            )

    return run


def train(labelled: DataFrame, rows_per_lang: int = TRAIN_ROWS) -> Model:
    """A model from ``labelled(doc_id, text, lang)``; rows with a null in text or lang don't count."""
    usable = labelled.where("text is not null and lang is not null and text rlike '[^\\\\x00-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]'")
    there = {r["lang"]: r["count"] for r in labelled.where("text is not null and lang is not null").groupBy("lang").count().collect()}
    if not there:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for lang, n in there.items() for x in (lang, min(1.0, rows_per_lang / n))])
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")
    dense = sample.mapInArrow(_counts, "lang string, counts binary").groupBy("lang").applyInArrow(_of_language, "lang string, counts binary")
    found = {r["lang"]: np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in dense.toLocalIterator()}
    langs = sorted(found)
    model = Model(langs, np.array([found[x] for x in langs], np.float64).reshape(len(langs), BUCKETS))
    if len(langs) > 1:
        shared = labelled.sparkSession.sparkContext.broadcast(model)
        trial = sample.where(F.col("lang").isin(langs)).mapInArrow(_trials(shared), "k int, j int, n double, size double, right double")
        got = trial.groupBy("k", "j").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("right").alias("right")).collect()
        size = np.zeros(model.code.shape)
        for r in got:
            n = max(r["n"], 1.0)
            size[r["k"], r["j"]] = r["size"] / n
            model.trust[r["k"], r["j"]] = (r["right"] + 0.5) / (n + 1)
        model.scale = np.maximum(size.mean(axis=0), 1e-9)
    return model


def _predict(shared):
    def run(batches):
        for b in batches:
            found = [shared.value.predict(t) for t in b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
            lang, score, flag = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(c for c, n in zip(b.columns, b.schema.names, strict=True) if n != "text"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(flag, pa.bool_())],
                names=[*(n for n in b.schema.names if n != "text"), "lang_pred", "score", "ambiguous"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` for every row of ``docs(doc_id, text, ...)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x BUCKETS
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def _accepted(shared, least: float):
    def run(batches):
        for b in batches:
            found = [shared.value.predict(t) for t in b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array([lang != "und" and (score >= least or not flag) for lang, score, flag in found], pa.bool_()))

    return run


def drop_unidentified(docs: DataFrame, model: Model, chance: float = 1.02) -> DataFrame:
    """``docs`` without texts that have no language: no letter, or no evidence for any language.

    The latter are ambiguous texts with a score under ``chance`` times one in the number of
    languages. Short or mixed texts stay: their best language has some evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_accepted(shared, chance / max(len(model.langs), 1)), docs.schema)


def fold(docs: DataFrame):
    """The fold number of a document: crc32 of doc_id as text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(docs) % 5 != 0))
    return predict(docs, model).select("doc_id", (fold(docs) % 5 == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op5_language_id": op5_language_id}
