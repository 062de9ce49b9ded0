"""Operator 8: language-model scores by Katz backoff with Good-Turing discounts, of any order.

Tokens are the white-space words of a text, A-Z lower-cased, and one end. Before a text stand
begin marks. With c(h, w) the training count of w after the history h, and h' for h without its
first token,

    P(w | h) = d(c) * c(h, w) / c(h)      if c = c(h, w) > 0
             = alpha(h) * P(w | h')       else, with alpha(h) = (1 - seen mass) / (1 - P(seen | h'))
    P(w)     = d'(c) * c(w) / N           if c(w) > 0, else all that is left: one unknown event

so P(. | h) sums to exactly one over the vocabulary and the unknown event, for each h. d(1..5) are
Katz's Good-Turing discounts from the counts of counts of that length; where these are not usable
(not in (0, 1), or a count of zero) the absolute discount n1 / (n1 + 2 n2) takes their place. A
history whose n-grams are all too frequent for a discount keeps one part in c(h) + 1 for the
unseen. A history without training counts leaves P(w | h').

Tables. N-grams are exact, not hashed: the bucket that owns a word gives it a number, frequent
words small ones, and an n-gram is the numbers of its words (0 for a begin mark in a history, and
as the last one for all words that do not follow h' in training). All n-grams of a history are in
one bucket. A history of very many tokens is split, as often as its count asks for, by its last
words; its parts are a family of rows of their own. A bucket holds one partition of the count table
of a length (n-grams and counts) and of the backoff weights of their histories: how many followers
have each discounted count, how many have each discounted count after h', and the sum of the
counts after h' that have no discount. As all followers of h follow h' too, both masses of
alpha(h) follow from these whole numbers and the counts of h and h', exactly and in any order.
``Model.save`` keeps the tables; ``Model.score`` scores any other corpus by them.

Counting and look-up are the same exchange, once a length. Texts are cut into pieces of some
thousand rows, written once as word numbers. A piece sends each bucket its distinct n-grams with
their local counts and their counts without the first token, so one in a third of all rows is sent
once a piece; the bucket adds them up and answers with counts in the same order, and with the
weights of the histories that have an unseen or an undiscounted n-gram in the piece. The answers
are written into the piece, which takes the place of the one before, so that what is on disk at
once is one state of the pieces, the tables, and the requests and answers of one length. Scores
are evaluated from the shortest history to the longest, token by token. All training documents
count and every text is scored whole. The driver gets counts of counts and the summed weights of
split histories only, of which there are some eight a bucket at most.

Buckets are as many as keep ``BUCKET_TOKENS`` tokens each, so a task's memory does not grow with
the corpus; an exchange has pieces x buckets rows, so for very large corpora both sizes are to be
raised as executors allow.

Defined cases: a null text is empty and scores its end alone; without training documents every
score is 0 (probability one of the unknown event); repeated rows are rows like any other; ties do
not arise; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.pieces import LEAST_BUCKETS, NO_ID, ODD, Numbers, mix, pack, pack_ints, unpack, unpack_ints
from tidemark.session import discard, materialise, table

ORDER = 3
K = 5
#: Text of a piece; a task holds some sixty times as much in arrays of all lengths.
PIECE_BYTES = 4 << 20
BUCKET_TOKENS = 1 << 20
#: A history is split into parts of some ``BUCKET_TOKENS / SHARES`` tokens.
SHARES = 4
#: Weights of a history: followers of count 1..K, followers of count 1..K after h', and the sum of the other counts after h'.
WEIGHTS = 2 * K + 1
ANSWER, TABLE, STATS, SPLIT = "answer", "table", "stats", "split"


# ---------------------------------------------------------------- the model's constants
def discounts(n: np.ndarray) -> np.ndarray:
    """d(r) for r = 0..K from counts of counts n[1..K+1]; d(0) is unused."""
    d = np.ones(K + 1)
    if n[1] <= 0:
        return d
    flat = n[1] / (n[1] + 2 * n[2])
    common = (K + 1) * n[K + 1] / n[1]
    for r in range(1, K + 1):
        good = -1.0
        if n[r] > 0 and n[r + 1] > 0 and common < 1:
            good = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
        d[r] = good if 0 < good < 1 else max((r - flat) / r, 0.0) or 0.5
    return d


class Constants:
    """Discounts of each length; N tokens and V distinct ones in training.

    ``stats[m]``: tokens, distinct n-grams, and counts of counts 1..K+1 of length m.
    """

    def __init__(self, stats: dict[int, np.ndarray]):
        words = stats.get(1, np.zeros(K + 3, np.int64))
        self.n, self.v = int(words[0]), int(words[1])
        self.d = {m: discounts(s[1:]) for m, s in stats.items()}
        left = (words[2 : K + 2] * np.arange(1, K + 1) * (1 - self.d[1][1:])).sum() / self.n if self.n else 1.0
        self.keep = 1.0 if left > 0 else self.n / (self.n + 1)
        self.unknown = left if left > 0 else 1 / (self.n + 1)

    def discount(self, m: int) -> np.ndarray:
        return self.d.get(m, np.ones(K + 1))

    def discounted(self, m: int, c: np.ndarray) -> np.ndarray:
        return np.where(c <= K, self.discount(m)[np.minimum(c, K)], 1.0) * c

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.keep * self.discounted(1, c) / max(self.n, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


# ---------------------------------------------------------------- pieces
PIECE_SCHEMA = "piece long, n_tokens long, ids binary, flags binary, lengths binary, tokens binary, words binary, counts binary"


def _number(size: int):
    """Pieces of rows (id, flag, text), their words numbered; number 0 is the end of a text."""

    def run(batches):
        held, count, n = [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def flush():
            ids, flags, texts = zip(*held, strict=True)
            number, lengths = Numbers({b"": 0}), []

            def lists():
                for t in texts:
                    w = t.split()
                    lengths.append(len(w) + 1)
                    yield w
                    yield (b"",)

            tokens = np.fromiter(map(number.__getitem__, chain.from_iterable(lists())), np.uint32)
            flags, lengths = np.array(flags, np.int8), np.array(lengths, np.int64)
            counts = np.bincount(tokens[np.repeat(flags == 0, lengths)], minlength=len(number))
            cols = [pack(np.array(ids, np.int64)), pack(flags), pack_ints(lengths), pack_ints(tokens), zstandard.ZstdCompressor(1).compress(b" ".join(number)), pack_ints(counts)]
            return pa.RecordBatch.from_arrays([pa.array([task + n], pa.int64()), pa.array([len(tokens)], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], names=[x.split(" ")[0] for x in PIECE_SCHEMA.split(", ")])

        for b in batches:
            for i, flag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                t = text.lower() if text else b""
                if held and count + len(t) > size:
                    yield flush()
                    held, count, n = [], 0, n + 1
                held.append((i, flag, t))
                count += len(t)
        if held:
            yield flush()

    return run


def _words(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split(b" ")


def _owners(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)


REQUEST_SCHEMA = "bucket int, family int, piece long, a binary, b binary, c binary"
ANSWER_SCHEMA = "kind string, bucket int, family int, piece long, a binary, b binary, c binary"
STATE_SCHEMA = "piece long, docs long, ids binary, flags binary, lengths binary, tokens binary, numbers binary, counts binary, levels array<binary>"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}
    fields = [(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(fields)})


def whole_family(m: int) -> int:
    return 2 * m


def split_family(m: int) -> int:
    """N-grams of length m whose histories are split over buckets."""
    return 2 * m + 1


def _ask_words(buckets: int):
    def run(batches):
        for b in batches:
            for piece, words, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words, counts = _words(words), unpack_ints(counts, np.int64)
                owner = _owners(words, buckets)
                order = np.argsort(owner, kind="stable")
                at, first = np.unique(owner[order], return_index=True)
                rows = [(int(i), whole_family(1), piece, zstandard.ZstdCompressor(1).compress(b" ".join([words[j] for j in mine.tolist()])), pack_ints(counts[mine]), None) for i, mine in zip(at, np.split(order, first[1:]), strict=True)]
                yield from _rows(REQUEST_SCHEMA, rows).to_batches()

    return run


# ---------------------------------------------------------------- buckets
def _stats(summed: np.ndarray) -> bytes:
    of = np.bincount(np.minimum(summed, K + 2), minlength=K + 3)[1 : K + 2]
    return pack(np.array([summed.sum(), (summed > 0).sum(), *of], np.int64))


def _own_words(bucket: int, train: bool, known: list[dict], asked: list[dict]) -> list[tuple]:
    number, parts = Numbers(), []
    for r in known + asked:
        parts.append((np.fromiter(map(number.__getitem__, _words(r["a"])), np.int64), unpack_ints(r["b"], np.int64)))
    summed = np.zeros(len(number), np.int64)
    for where, c in parts:
        summed[where] += c  # the words of a part are distinct
    seen = np.flatnonzero(summed)
    if train:
        seen = seen[np.argsort(-summed[seen], kind="stable")]  # frequent words get small numbers
    place = np.zeros(len(number), np.int64)
    place[seen] = np.arange(1, len(seen) + 1)
    family = whole_family(1)
    rows = [(ANSWER, bucket, family, r["piece"], pack_ints(summed[w]), pack_ints(place[w]), None) for r, (w, _) in zip(asked, parts[len(known) :], strict=True)]
    if train:
        words = list(number)
        held = zstandard.ZstdCompressor(3).compress(b" ".join([words[i] for i in seen.tolist()]))
        if len(seen):
            rows.append((TABLE, bucket, family, -1, held, pack_ints(summed[seen]), None))
        rows.append((STATS, bucket, family, -1, _stats(summed), None, None))
    return rows


def _pack_grams(cols: np.ndarray) -> bytes:
    """The words of sorted n-grams, a row a position, as differences where all before them are equal."""
    new, out = np.arange(cols.shape[1]) == 0, []
    for c in cols:
        d = c.copy()
        d[1:] -= np.where(new[1:], np.uint64(0), c[:-1])
        new[1:] |= c[1:] != c[:-1]
        out.append(d)
    return pack_ints(np.stack(out))


def _unpack_grams(b: bytes, m: int) -> np.ndarray:
    cols = unpack_ints(b, np.uint64).reshape(m, -1)
    new = np.arange(cols.shape[1]) == 0
    for i, d in enumerate(cols):
        at, to = np.flatnonzero(new), np.cumsum(d, dtype=np.uint64)
        cols[i] = to - np.repeat((to - d)[at], np.diff(at, append=len(d)))
        new[1:] |= cols[i, 1:] != cols[i, :-1]
    return cols


def _weights(b: bytes) -> np.ndarray:
    return unpack_ints(b, np.int64).reshape(WEIGHTS, -1)


def _key(cols: np.ndarray) -> np.ndarray:
    """One number an n-gram, in the order of the n-grams: prefixes are numbered where 64 bits are too few."""
    key, used = cols[0], int(cols[0].max(initial=0)).bit_length()
    for c in cols[1:]:
        more = int(c.max(initial=0)).bit_length()
        if used + more > 64:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            used = len(key).bit_length()
        key, used = key << np.uint64(more) | c, used + more
    return key


def _undiscounted(c: np.ndarray) -> np.ndarray:
    return (c == 0) | (c > K)


def _own_grams(bucket: int, family: int, train: bool, known: list[dict], asked: list[dict]) -> list[tuple]:
    m, split = family // 2, family % 2
    parts = [(_unpack_grams(r["a"], m), unpack_ints(r["b"], np.int64)) for r in known + asked]
    cols, c = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
    key = _key(cols)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    where = np.empty(len(key), np.int64)
    where[order] = np.cumsum(new) - 1
    grams = cols[:, order[new]]
    change = np.ones(grams.shape[1], bool)
    change[1:] = (grams[:-1, 1:] != grams[:-1, :-1]).any(axis=0)
    history, n = np.cumsum(change) - 1, int(change.sum())
    summed = np.bincount(where, c, len(change)).astype(np.int64)  # exact up to 2**53
    seen = summed > 0
    if train:
        lower = np.zeros(len(change), np.int64)
        lower[where[c > 0]] = np.concatenate([unpack_ints(r["c"], np.int64) for r in asked])[c > 0]
        small, big = seen & (summed <= K), seen & (lower > K)
        near = seen & ~big
        weights = np.concatenate([
            np.bincount((summed[small] - 1) * n + history[small], minlength=K * n),
            np.bincount((lower[near] - 1) * n + history[near], minlength=K * n),
            np.bincount(history[big], lower[big], n).astype(np.int64),
        ]).reshape(WEIGHTS, n)
    else:
        weights = np.zeros((WEIGHTS, n), np.int64)
        if known:  # its histories, each once and in order
            weights[:, np.unique(history[where[: len(parts[0][1])]])] = _weights(known[0]["c"])
    rows, at = [], sum(len(p[1]) for p in parts[: len(known)])
    for r, (_, own) in zip(asked, parts[len(known) :], strict=True):
        mine = where[at : at + len(own)]
        at += len(own)
        counts = summed[mine]
        wanted = np.unique(history[mine[_undiscounted(counts)]])
        rows.append((ANSWER, bucket, family, r["piece"], pack_ints(counts), None if split else pack_ints(weights[:, wanted]), None))
    if train:
        if seen.any():
            held = np.unique(history[seen])
            held = held if len(held) < n else slice(None)
            rows.append((TABLE, bucket, family, -1, _pack_grams(grams[:, seen]), pack_ints(summed[seen]), pack_ints(weights[:, held])))
            if split:
                rows.append((SPLIT, bucket, family, -1, _pack_grams(grams[:-1, change][:, held]), pack_ints(weights[:, held]), None))
        rows.append((STATS, bucket, family, -1, _stats(summed), None, None))
    return rows


def _own(train: bool, asked: pa.Table, known: list[dict]) -> pa.Table:
    """One bucket of one family: answers to all pieces; in training also its table."""
    if not asked.num_rows:
        return _rows(ANSWER_SCHEMA, [])
    bucket, family = (asked.column(c)[0].as_py() for c in ("bucket", "family"))
    rows = asked.sort_by("piece").to_pylist()
    if family == whole_family(1):
        return _rows(ANSWER_SCHEMA, _own_words(bucket, train, known, rows))
    return _rows(ANSWER_SCHEMA, _own_grams(bucket, family, train, known, rows))


def _count(asked: pa.Table) -> pa.Table:
    return _own(True, asked, [])


def _look_up(asked: pa.Table, tables: pa.Table) -> pa.Table:
    return _own(False, asked, tables.to_pylist())


# ---------------------------------------------------------------- one piece
@dataclass(frozen=True)
class Plan:
    """Where n-grams are owned."""

    order: int
    buckets: int
    share: int  # a history is split into a part for each so many of its tokens


class Words:
    """The distinct words of a piece, sorted by number; first the unknown one, which stands for all without training counts."""

    def __init__(self, of: np.ndarray, number: np.ndarray, count: np.ndarray):
        self.of, self.cols, self.count = of, [number], count  # of: which one ends at each token


class Grams:
    """The distinct n-grams of length m of a piece as pairs of a history and a word, both in order of numbers."""

    def __init__(self, words: Words, before: Words | Grams, starts: np.ndarray, docs: int):
        self.words, self.before, self.m = words, before, len(before.cols) + 1
        self.context = np.concatenate([[0], before.of[:-1] + 1]) if len(before.of) else before.of
        self.context[starts] = 0  # begin marks only
        self.history_count = np.concatenate([[docs], before.count])
        word = np.where(before.count[before.of] > 0, words.of, 0)  # as good as unknown here: with the shorter n-gram unseen, so is this one
        keys, self.of = np.unique(self.context * len(words.count) + word, return_inverse=True)
        self.history, self.last = np.divmod(keys, len(words.count))
        self.asked = np.flatnonzero(self.history_count[self.history] > 0)
        self.count = np.zeros(len(keys), np.int64)

    @property
    def histories(self) -> list[np.ndarray]:
        return [np.concatenate([[np.uint64(0)], c]) for c in self.before.cols]

    @property
    def cols(self) -> list[np.ndarray]:
        return [*(c[self.history] for c in self.histories), self.words.cols[0][self.last]]

    def _owners(self, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owners of all histories (of a split one its first part's) and which are split; for each n-gram asked for its family and bucket as one number."""
        key = np.zeros(len(self.history_count), np.uint64)
        for c in self.histories:
            key = mix(key * ODD + c)
        parts = (1 + self.history_count // plan.share).astype(np.uint64)
        n, h = np.uint64(plan.buckets), self.history[self.asked]
        part = mix(self.words.cols[0][self.last[self.asked]]) % parts[h]
        split = parts > 1
        at = mix(key[h] + part * ODD) % n + n * split[h]
        return mix(key) % n, split, at.astype(np.uint16) if plan.buckets < 1 << 15 else at

    def request(self, piece: int, learn: np.ndarray, plan: Plan) -> list[tuple]:
        """Rows that ask for the counts of these n-grams, and add those of the piece."""
        at = self._owners(plan)[2]
        by = np.argsort(at, kind="stable")
        groups, first = np.unique(at[by], return_index=True)
        local = np.bincount(self.of[learn], minlength=len(self.count))
        example = np.empty(len(self.count), np.int64)
        example[self.of] = np.arange(len(self.of))
        lower = np.where(local > 0, self.before.count[self.before.of[example]], 0)
        cols, rows = np.stack(self.cols), []
        for g, mine in zip(groups.tolist(), np.split(self.asked[by], first[1:]), strict=True) if len(groups) else ():
            family = split_family(self.m) if g >= plan.buckets else whole_family(self.m)
            rows.append((g % plan.buckets, family, piece, _pack_grams(cols[:, mine]), pack_ints(local[mine]), pack_ints(lower[mine])))
        return rows

    def _want(self) -> np.ndarray:
        """Histories whose weights are needed: one of their n-grams is unseen or too frequent for a discount."""
        want = np.zeros(len(self.history_count), bool)
        want[self.history[self.asked[_undiscounted(self.count[self.asked])]]] = True
        return want

    def take(self, answers: list[dict], plan: Plan, splits: tuple[np.ndarray, np.ndarray]) -> None:
        """Counts and weights from the buckets' answers; ``splits`` has the weights of split histories."""
        owner, split, at = self._owners(plan)
        if answers:
            self.count[self.asked[np.argsort(at, kind="stable")]] = np.concatenate([unpack_ints(r["a"], np.int64) for r in answers])
        want = self._want()
        weights = np.zeros((WEIGHTS, len(want)), np.int64)
        whole = np.flatnonzero(want & ~split)
        if len(whole):
            weights[:, whole[np.argsort(owner[whole], kind="stable")]] = np.concatenate([_weights(r["b"]) for r in answers if r["b"] is not None], axis=1)
        parted = np.flatnonzero(want & split)
        if len(parted):
            place = {h: i for i, h in enumerate(zip(*splits[0].tolist(), strict=True))}
            weights[:, parted] = splits[1][:, [place[h] for h in zip(*(c[parted].tolist() for c in self.histories), strict=True)]]
        self.want, self.weights = np.flatnonzero(want), weights[:, want]

    def packed(self) -> list[bytes]:
        return [pack_ints(self.count[self.asked]), pack_ints(self.weights)]

    def read(self, counts: bytes, weights: bytes) -> None:
        self.count[self.asked] = unpack_ints(counts, np.int64)
        self.want, self.weights = np.flatnonzero(self._want()), _weights(weights)

    def probability(self, p: np.ndarray, k: Constants) -> np.ndarray:
        """P of each token, from its P by a history that is one shorter."""
        d, r, n = k.discount(self.m), np.arange(1, K + 1), len(self.history_count)
        self.total = np.maximum(self.history_count, 1)
        free = np.full(n, float((d[1:] < 1).any()))  # more than zero: the others have a follower with a discount
        free[self.want] = (r * (1 - d[1:])) @ self.weights[:K] / self.total[self.want]
        full = free <= 1e-12
        self.keep = np.where(full, self.total / (self.total + 1), 1.0)
        mass = (r * k.discount(self.m - 1)[1:]) @ self.weights[K : 2 * K] + self.weights[2 * K]
        if self.m == 2:
            mass *= k.keep / max(k.n, 1)
        else:
            example = np.zeros(n, np.int64)
            example[self.context] = np.arange(len(self.context))
            shorter = self.before.context[example[self.want]]
            mass *= self.before.keep[shorter] / self.before.total[shorter]
        alpha = np.ones(n)  # also after a history without training counts
        alpha[self.want] = np.where(full, 1 / (self.total + 1), free)[self.want] / np.maximum(1 - mass, 1e-300)
        seen = self.keep[self.history] * k.discounted(self.m, self.count) / self.total[self.history]
        return np.where((self.count > 0)[self.of], seen[self.of], alpha[self.history][self.of] * p)


class Piece:
    """The texts of a piece and their n-grams, as far as the answers have come."""

    def __init__(self, row: dict):
        self.row, self.docs = row, row["docs"]
        self.ids, self.flags, self.lengths = unpack(row["ids"], np.int64), unpack(row["flags"], np.int8), unpack_ints(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = Words(unpack_ints(row["tokens"], np.int64), unpack_ints(row["numbers"], np.uint64), unpack_ints(row["counts"], np.int64))
        self.levels: list[Words | Grams] = [self.words]
        for counts, weights in zip(row["levels"][::2], row["levels"][1::2], strict=True):
            self.grow().read(counts, weights)

    def grow(self) -> Grams:
        """The n-grams that are one longer, without counts yet."""
        self.levels.append(Grams(self.words, self.levels[-1], self.starts, self.docs))
        return self.levels[-1]

    def state(self) -> tuple:
        """The row of this piece, as of ``STATE_SCHEMA``, with the counts of its longest n-grams."""
        levels = [*self.row["levels"], *(self.levels[-1].packed() if len(self.levels) > 1 else [])]
        return tuple((self.row | {"levels": levels})[x.split(" ")[0]] for x in STATE_SCHEMA.split(", "))

    def probabilities(self, k: Constants) -> np.ndarray:
        p = k.unigram(self.words.count)[self.words.of]
        for g in self.levels[1:]:
            p = g.probability(p, k)
        return p


def _numbered(row: dict, answers: list[dict], plan: Plan) -> Piece:
    """A piece whose words have the numbers and counts of their owners."""
    owner = _owners(_words(row["words"]), plan.buckets)
    by = np.argsort(owner, kind="stable")
    count, number = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.uint64)
    count[by], place = (np.concatenate([unpack_ints(r[c], np.int64) for r in answers]) for c in "ab")
    number[by] = np.where(place > 0, (place - 1) * plan.buckets + owner[by].astype(np.int64) + 1, 0)
    known = np.flatnonzero(count > 0)
    known = known[np.argsort(number[known])]
    of = np.zeros(len(owner), np.int64)
    of[known] = np.arange(1, len(known) + 1)
    packed = {
        "docs": int(count[0]),  # the end of a text, once a training document
        "tokens": pack_ints(of[unpack_ints(row["tokens"], np.int64)]),
        "numbers": pack_ints(np.concatenate([[np.uint64(0)], number[known]])),
        "counts": pack_ints(np.concatenate([[0], count[known]])),
        "levels": [],
    }
    return Piece(row | packed)


def _joined(pieces: pa.Table, answers: pa.Table, m: int, plan: Plan, splits: tuple[np.ndarray, np.ndarray]):
    """Pieces with the answers of length m."""
    got = answers.sort_by([("family", "ascending"), ("bucket", "ascending")]).to_pylist()
    for row in pieces.to_pylist():
        if m == 1:
            yield _numbered(row, got, plan)
        else:
            p = Piece(row)
            p.grow().take(got, plan, splits)
            yield p


def _join(m: int, plan: Plan, splits: tuple[np.ndarray, np.ndarray]):
    def run(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        return _rows(STATE_SCHEMA, [p.state() for p in _joined(pieces, answers, m, plan, splits)])

    return run


def _ask(plan: Plan):
    """Requests of the n-grams that are one longer than those of the state."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                p = Piece({n: b.column(n)[i].as_py() for n in b.schema.names})
                rows = p.grow().request(p.row["piece"], np.repeat(p.flags == 0, p.lengths), plan)
                yield from _rows(REQUEST_SCHEMA, rows).to_batches()

    return run


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(plan: Plan, splits: tuple[np.ndarray, np.ndarray], constants: Constants):
    def run(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for p in _joined(pieces, answers, plan.order, plan, splits):
            c = p.words.count
            each = {"n_known": (c > 0)[p.words.of].astype(np.int64), "base_score": constants.base(c)[p.words.of], "score": np.log10(p.probabilities(constants))}
            cols = {"doc_id": pa.array(p.ids, mask=p.ids == NO_ID), "held_out": pa.array(p.flags == 1), "n_tokens": pa.array(p.lengths)}
            out.append(pa.table(cols | {n: pa.array(np.add.reduceat(v, p.starts)) for n, v in each.items()}))  # every text has its end at least
        return pa.concat_tables(out)

    return run


# ---------------------------------------------------------------- Spark
def _pieces(docs: DataFrame, held_out, size: int) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(held_out, F.lit(False)).cast("tinyint").alias("flag"), "text")
    return materialise(rows.mapInArrow(_number(size), PIECE_SCHEMA), "numbered")


def _constants(stats: DataFrame) -> Constants:
    found: dict[int, np.ndarray] = {}
    for r in stats.where(F.col("kind") == STATS).select("family", "a").toLocalIterator():  # a few numbers a bucket
        found[r["family"] // 2] = found.get(r["family"] // 2, 0) + unpack(bytes(r["a"]), np.int64)
    return Constants(found or {1: np.zeros(K + 3, np.int64)})


def _splits(tables: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The split histories of n-grams of length m, and their weights summed over their parts."""
    found: dict[tuple, np.ndarray] = {}
    for r in tables.where((F.col("kind") == SPLIT) & (F.col("family") == split_family(m))).select("a", "b").toLocalIterator():  # some eight histories a bucket at most
        cols, weights = _unpack_grams(bytes(r["a"]), m - 1), _weights(bytes(r["b"]))
        for h, w in zip(zip(*cols.tolist(), strict=True), weights.T, strict=True):
            found[h] = found.get(h, 0) + w
    return np.array(list(found), np.uint64).reshape(-1, max(m - 1, 1)).T, np.array(list(found.values()), np.int64).reshape(-1, WEIGHTS).T


def _exchange(pieces: DataFrame, plan: Plan, tables: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pieces but for the answers of the last length, all answers of that, and the tables of all lengths (in training: no ``tables``)."""

    def answer(asked: DataFrame, m: int) -> DataFrame:
        by = asked.groupBy("bucket", "family")
        if tables is None:
            return materialise(by.applyInArrow(_count, ANSWER_SCHEMA), "grams", ("kind",))
        there = tables.where((F.col("kind") == TABLE) & F.col("family").isin(whole_family(m), split_family(m))).groupBy("bucket", "family")
        return materialise(by.cogroup(there).applyInArrow(_look_up, ANSWER_SCHEMA), "grams", ("kind",))

    got = answer(pieces.select("piece", "words", "counts").mapInArrow(_ask_words(plan.buckets), REQUEST_SCHEMA), 1)
    made = got
    for m in range(1, plan.order):
        state = materialise(_meet(pieces, got).applyInArrow(_join(m, plan, _splits(made if tables is None else tables, m)), STATE_SCHEMA), "state")
        discard(pieces)  # the state stands in for them
        discard(got, f"kind={ANSWER}")
        pieces = state
        got = answer(pieces.mapInArrow(_ask(plan), REQUEST_SCHEMA), m + 1)
        made = made.union(got)
    return pieces, got, made if tables is None else tables


def _meet(pieces: DataFrame, got: DataFrame):
    return pieces.groupBy("piece").cogroup(got.where(F.col("kind") == ANSWER).groupBy("piece"))


def _scores(pieces: DataFrame, plan: Plan, tables: DataFrame | None) -> DataFrame:
    last, got, tables = _exchange(pieces, plan, tables)
    constants = _constants(tables)
    out = _meet(last, got).applyInArrow(_score(plan, _splits(tables, plan.order), constants), SCORE_SCHEMA)
    return out.withColumn("train_tokens", F.lit(constants.n).cast("long"))


def _plan(pieces: DataFrame, order: int, tokens: int) -> Plan:
    n = pieces.agg(F.sum("n_tokens")).first()[0] or 0
    return Plan(order, max(LEAST_BUCKETS, -(-n // tokens)), max(tokens // SHARES, 1))


@dataclass
class Model:
    """A trained model: its tables ``(kind, bucket, family, piece, a, b, c)``, one row a kind, bucket and family."""

    tables: DataFrame
    plan: Plan

    @property
    def order(self) -> int:
        return self.plan.order

    def save(self, path: str) -> None:
        """Write the tables, a folder for each kind and family."""
        self.tables.withColumns({k: F.lit(v) for k, v in asdict(self.plan).items()}).write.partitionBy("kind", "family").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        t = spark.read.schema(f"{ANSWER_SCHEMA}, order int, buckets int, share int").parquet(path)
        return cls(t.drop("order", "buckets", "share"), Plan(*t.select("order", "buckets", "share").first()))

    def score(self, docs: DataFrame, size: int = PIECE_BYTES) -> DataFrame:
        """Score every row of ``docs``, none of which is learnt from; columns as of ``score``."""
        return _scores(_pieces(docs, F.lit(True), size), self.plan, self.tables)


def train(docs: DataFrame, order: int = ORDER, size: int = PIECE_BYTES, tokens: int = BUCKET_TOKENS) -> Model:
    """A model of all rows of ``docs``."""
    pieces = _pieces(docs, F.lit(False), size)
    plan = _plan(pieces, order, tokens)
    return Model(_exchange(pieces, plan, None)[2].where(F.col("kind") != ANSWER), plan)


def score(docs: DataFrame, held_out, order: int = ORDER, size: int = PIECE_BYTES, tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Train on the rows of ``docs`` where ``held_out`` is false; score every row.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).
    """
    pieces = _pieces(docs, held_out, size)
    return _scores(pieces, _plan(pieces, order, tokens), None)


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import fold

    docs = table(spark, sf_dir, "documents")
    return score(docs, fold(docs) % 5 == 1)


QUERIES = {"op8_katz_backoff": op8_katz_backoff}
