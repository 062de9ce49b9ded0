"""Operators on texts against brute force, and their defined edge cases."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import decontaminate, katz, langid, licenses, mixing, secrets, simhash, substring
from tidemark.session import scratch_dir

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeats, a long text, and extra columns with clashing names."""
    long = "word " * 60000 + "é end password=abcdef12"
    rows = [(1, None, "en"), (2, "", "en"), (3, "same text here now", None), (3, "same text here now", None), (None, "no id at all", "fr"), (5, "  \n\t ", "de"), (6, long, "en"), (7, "x", "en"), (8, "same text here now", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = ("spans", "fp", "row", "base", "copy", "flag", "_d", "key", "rate", "score")
    return d.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(1) for c in clash})


def lower(text):
    return (text or "").encode().lower()


# ---------------------------------------------------------------- 1
def brute_fingerprint(text):
    words = WORD.findall(lower(text))
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_all_pairs(spark, docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


@pytest.mark.parametrize("max_group", [4096, 3])
def test_links_equal_all_pairs_also_through_fine_lanes(spark, max_group):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(25)}
    ids = dict(enumerate(sorted(fps)))
    want = brute_components(ids)
    d = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in ids.values()], "fp long")
    back = {int(np.uint64(f).view(np.int64)): i for i, f in ids.items()}
    links = [(back[r.a], back[r.b]) for r in simhash.links(d, max_group).collect()]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        assert (ids[a] ^ ids[b]).bit_count() <= 3
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {i: find(i) for i in ids} == want


def test_simhash_edge_cases(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == comp[5] == 1 and comp[3] == comp[8] == 3 and comp[None] is None
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- 3
def test_mixing_rates_and_counts(spark, docs, odd):
    got = mixing.mix(docs, {f"src{i}": float(i % 3) for i in range(20)}).toPandas()
    assert not got["source"].isin([f"src{i}" for i in range(0, 20, 3)]).any()
    rate = {r.source: r.rate for r in mixing.rates(docs, {f"src{i}": float(i % 3) for i in range(20)}).collect()}
    n = got.groupby("doc_id").size()
    for r in docs.collect():
        u, lam, k, p = int(hashlib.md5(f"42:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52, rate[r.source], 0, 0.0
        if lam <= mixing.PART:
            p = math.exp(-lam)
            c = p
            while c <= u:
                k += 1
                p *= lam / k
                c += p
            assert n.get(r.doc_id, 0) == k
    few = docs.where("doc_id < 20")  # rates far over PART: sums of parts
    rate = {r.source: r.rate for r in mixing.rates(few, budget=4e7).collect()}
    want = sum(rate[r.source] for r in few.collect())
    assert max(rate.values()) > 5 * mixing.PART and abs(mixing.mix(few, budget=4e7).count() - want) < 6 * math.sqrt(want)
    out = mixing.mix(odd)
    assert [c for c in out.columns if c not in ("copy", "mix_key")] == [c for c in odd.columns if c != "copy"]
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(docs).exceptAll(mixing.mix(docs)).count() == 0


# ---------------------------------------------------------------- 4
def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    words = brute_words(text)
    hit, found = set(), set()
    for item, wins in items.items():
        for w in wins:
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark, docs):
    bench = spark.createDataFrame([("a", "That it."), ("b", None), (None, "the of"), ("c", "--"), ("d", "The the"), ("d", "the the")], "item_id string, text string")
    real = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").cast("string"), "text")
    items = {}
    for r in bench.union(real).collect():
        w = brute_words(r.text)
        if r.item_id is not None and w:
            items.setdefault(r.item_id, []).extend([w[i : i + 10] for i in range(max(1, len(w) - 9))])
    some = docs.where("doc_id % 2 = 0")
    want = {r.doc_id: brute_hits(r.text, items) for r in some.collect()}
    for max_bytes in (1 << 20, 300):  # one automaton, or many in turn
        got = decontaminate.scan(some, bench.union(real), max_bytes=max_bytes)
        rows = got.collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == want
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in rows:
        assert sum(len(decontaminate.WORD.findall(texts[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit
    assert any(r.n_hit for r in rows)


def test_decontamination_edge_cases(spark, odd):
    bench = spark.createDataFrame([(1, "same text")], "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit) for r in decontaminate.scan(odd, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0), (2, 0, 0), (3, 4, 2), (3, 4, 2), (None, 4, 0), (5, 0, 0), (6, 60004, 0), (7, 1, 0), (8, 4, 2)], key=str)
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 6
    assert decontaminate.scan(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan(odd.limit(0), bench).count() == 0


# ---------------------------------------------------------------- 5
def test_names_that_clash(spark):
    """Helper columns never meet columns of the input, whatever their names."""
    d = spark.createDataFrame([(1, "ten words of a text to be kept or not here", "a", 5, "h"), (2, "other", "b", 6, "i")], "doc_id long, text string, source string, _M_n int, _d_hits string")
    bench = spark.createDataFrame([(1, "other")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(d, bench)
    assert [tuple(r) for r in kept.collect()] == [tuple(r) for r in d.where("doc_id = 1").collect()] and kept.columns == d.columns
    out = mixing.mix(d, {"a": 1.0}, 100.0)
    assert {(r["_M_n"], r["_d_hits"]) for r in out.collect()} == {(5, "h")}
    assert mixing.mix(d.limit(0)).count() == 0


def test_language_held_out_accuracy(spark, docs):
    held = langid.fold(docs) % 5 == 0
    model = langid.train(docs.where(~held))
    got = langid.predict(docs, model).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def brute_languages(train, texts):
    """The decoder over plain dictionaries of counts, codeword by codeword and bit by bit."""

    def grams(text):
        low = text.encode().translate(langid.NORMAL).split()
        x = b" " + b" ".join(low) + b" "
        for i in range(len(x) - 2):
            h = ((x[i] * 0x9E3779B1 + x[i + 1] * 0x85EBCA77) ^ (x[i + 2] * 0xC2B2AE3D)) & 0xFFFFFFFF
            yield (((h ^ (h >> 15)) * 0x27D4EB2F) & 0xFFFFFFFF) >> 16

    counts = defaultdict(Counter)
    for lang, text in train:
        counts[lang].update(grams(text))
    langs = sorted(counts)
    code = langid.codewords(len(langs)).tolist()
    bits, size = range(len(code[0])), langid.BUCKETS
    total = {x: sum(counts[x].values()) + langid.SMOOTHING * size for x in langs}

    @functools.cache
    def weight(j, g):
        share = lambda sign: np.mean([(counts[x][g] + langid.SMOOTHING) / total[x] for x, c in zip(langs, code, strict=True) if c[j] == sign])
        return math.log(share(1)) - math.log(share(-1))

    def raw(text):
        g = list(grams(text))
        return [sum(weight(j, x) for x in g) / math.sqrt(max(len(g), 1)) for j in bits]

    margins = [(langs.index(lang), raw(text)) for lang, text in train]
    scale = [np.mean([np.mean([abs(m[j]) for k, m in margins if k == i]) for i in range(len(langs))]) for j in bits]
    trust = [[(sum(np.sign(m[j]) == code[i][j] for k, m in margins if k == i) + 0.5) / (sum(k == i for k, _ in margins) + 1) for j in bits] for i in range(len(langs))]
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            yield "und", 0.0
            continue
        m = [x / s for x, s in zip(raw(text), scale, strict=True)]
        loss = [sum(t * math.log1p(math.exp(-3 * c * x)) for t, c, x in zip(trust[i], code[i], m, strict=True)) / sum(trust[i]) for i in range(len(langs))]
        best = min(range(len(langs)), key=loss.__getitem__)
        yield langs[best], 1 / sum(math.exp(-4 * (x - loss[best])) for x in loss)


def test_language_equals_brute_force(spark, docs):
    d = docs.where("doc_id < 140 and (text is null or length(text) < 1200)")
    learn = langid.fold(d) % 5 != 0
    rows = d.select("doc_id", "text", "lang", learn.alias("learn")).collect()
    usable = [(r.lang, r.text) for r in rows if r.learn and r.lang and r.text and any(c.isalpha() for c in r.text)]
    want = dict(zip([r.doc_id for r in rows], brute_languages(usable, [r.text for r in rows]), strict=True))
    got = langid.predict(d, langid.train(d.where(learn))).collect()
    assert len(got) == len(want) > 40
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-3), r.doc_id


def test_two_hundred_languages(spark):
    rng = np.random.default_rng(4)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for _ in range(200)]
    rows = [(k * 10 + i, " ".join(rng.choice(words[k], 40)), f"l{k:03d}") for k in range(200) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d.where("doc_id % 10 < 5"))
    got = langid.predict(d.where("doc_id % 10 = 5"), model).collect()
    assert len(model.langs) == 200 and np.mean([r.lang_pred == f"l{r.doc_id // 10:03d}" for r in got]) > 0.97


def test_codewords_are_distinct():
    for n in (2, 3, 4, 5, 9, 30):
        c = langid.codewords(n)
        assert len({tuple(x) for x in c}) == n and (np.abs(c.sum(axis=0, dtype=int)) < n).all()


def test_language_edge_cases(spark, odd):
    model = langid.train(odd)
    got = {(r.doc_id, r.lang_pred == "und") for r in langid.predict(odd, model).collect()}
    assert {(1, True), (2, True), (5, True), (7, False)} <= got
    empty = langid.train(odd.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, empty).collect()} == {("und", 0.0)}
    one = langid.train(odd.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(odd, one).collect()} == {"und", "en"}
    assert langid.drop_unidentified(odd, model).columns == odd.columns


# ---------------------------------------------------------------- 6
def brute_removal(rows, window):
    seen = Counter()
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    for w in words:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def test_cover_meets_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_substring_dedup_equals_brute_force(spark, docs, odd):
    for d, window in ((docs, 35), (docs.where("doc_id < 60"), 21)):
        got = sorted(map(tuple, substring.remove_repeats(d, window).collect()), key=str)
        assert got == brute_removal([(r.doc_id, r.text) for r in d.collect()], window)
    got = sorted(map(tuple, substring.remove_repeats(odd).collect()), key=str)
    assert got == brute_removal([(r.doc_id, r.text) for r in odd.collect()], 35)
    assert substring.remove_repeats(odd.limit(0)).count() == 0


def test_shifted_passages_are_found(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.choice(vocab, 60))
    rows = [(i, " ".join([*rng.choice(vocab, i), passage, *rng.choice(vocab, 50)])) for i in range(45)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.remove_repeats(d).collect()), key=str) == brute_removal(rows, 35)


# ---------------------------------------------------------------- 7, 9
def test_license_scan_edge_cases(spark, odd):
    texts = [(n, t) for n, t in licenses.TEMPLATES]
    d = spark.createDataFrame([(i, f"Some words before.\n\n{t}\n\nMore words after, enough to dilute the whole. " + "pad " * 300) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    for i, (n, _) in enumerate(texts):
        assert got[i].best_license == n and got[i].best_dice == 1.0
    assert {r.licenses for r in licenses.scan_licenses(odd).collect()} == {""}
    assert licenses.scan_licenses(odd.limit(0)).count() == 0
    whole = "\n\n".join(f"Section {i}. " + " ".join(f"clause{i}x{j}" for j in range(60)) + "." for i in range(20))  # a whole license of one's own
    own = spark.createDataFrame([(1, f"Readme.\n\n{whole}\n\nThe end."), (2, "Readme.")], "doc_id long, text string")
    assert {(r.doc_id, r.licenses) for r in licenses.scan_licenses(own, templates=(("own", whole),)).collect()} == {(1, "own"), (2, "")}


def test_licenses_equal_brute_force_near_the_threshold(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        words = licenses._words(licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1])
        share = rng.uniform(0.55, 1)
        kept = [w for w in words if rng.random() < share] if i % 2 else words[: max(2, int(share * len(words)))] + ["other"] * int(rng.integers(0, 4))
        rows.append((i, " ".join(kept)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    some = 0
    for i, text in rows:
        w = text.split()
        grams = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        best = max((2 * len(grams & set(b)) / (len(grams) + len(b)), -k, n) for k, (n, b) in enumerate(licenses.template_bigrams())) if grams else (0, 0, None)
        if best[0] >= licenses.THRESHOLD:
            some += 1
            assert (got[i].best_license, got[i].best_dice) == (best[2], round(best[0], 6))
        else:
            assert got[i].best_license is None
    assert 50 < some < 250


PATTERNS = {
    "assign": re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?i:passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def brute_spans(text):
    spans = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                spans.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def test_secrets_equal_brute_force(spark, docs, odd):
    tricky = ["secret: token: abcdefgh", "token=token=abcdef", "AKIAAKIA" + "A" * 15, "é" * 5 + "Passwd='hunter2222'", "password = abc", "api_key=a.b-c_d==", "0" * 23, "0" * 24, "x" * 40,
              "key q7Zk9PbX2mW4tR8vN1cY6sD3 end", "uuid 123e4567-e89b-12d3-a456-426614174000", "a/b/some/longer/path/of/words"]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(tricky)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in secrets.scan_secrets(d).collect():
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k + ":") for k in PATTERNS)
        assert [s for s in r.spans.split(",") if s and "entropy" not in s] == [s for s in base.split(",") if s]
        for s in r.spans.split(","):
            if "entropy" in s:
                a, b = map(int, s.split(":")[1:])
                assert b - a >= 20 and entropy(texts[r.doc_id][a : a + 20]) >= 3.19
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(d).collect()}
    assert spans[10**6 + 9] == "entropy:4:28" and not spans[10**6 + 10] and not spans[10**6 + 11]
    out = secrets.redact(odd)
    assert out.columns == odd.columns and out.where("text like '%abcdef12%'").count() == 0 and out.where("text is null").count() == 1
    assert out.where("n_chars <> length(text)").count() == 0


# ---------------------------------------------------------------- 8
def brute_katz(train, order):
    """P(history of order - 1 tokens, word) of the recursive formula over plain dictionaries, and its counts of words."""
    grams = [Counter(tuple((["^"] * order + w)[i - m + 1 : i + 1]) for w in train for i in range(order, order + len(w))) for m in range(1, order + 1)]
    uni, total = grams[0], sum(grams[0].values())
    d = [katz.discounts(np.array([0] + [list(c.values()).count(r) for r in range(1, 7)])) for c in grams]

    def dis(c, m):
        return c * (d[m - 1][c] if c <= katz.K else 1)

    left = 1 - sum(dis(c, 1) for c in uni.values()) / total
    followers = [defaultdict(dict) for _ in grams]
    for m, counts in enumerate(grams):
        for g, c in counts.items():
            followers[m][g[:-1]][g[-1]] = c

    @functools.cache
    def weights(h):
        seen, m = followers[len(h)][h], len(h) + 1
        count = sum(seen.values())
        mass = sum(dis(c, m) for c in seen.values()) / count
        keep = 1.0 if 1 - mass > 1e-12 else count / (count + 1)
        return count, keep, (1 - keep * mass) / (1 - sum(p(h[1:], w) for w in seen))

    def p(h, w):
        if not h:
            return dis(uni[w,], 1) / total if (w,) in uni else left
        if h not in followers[len(h)]:
            return p(h[1:], w)
        count, keep, alpha = weights(h)
        c = followers[len(h)][h].get(w, 0)
        return keep * dis(c, len(h) + 1) / count if c else alpha * p(h[1:], w)

    return p, uni, followers


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_equals_brute_force(spark, docs, order):
    d = docs.where("doc_id < 120")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = {r.doc_id: r for r in katz.score(d, held, order, size=40_000, tokens=20_000).collect()}
    rows = [(r.doc_id, WORD.findall(lower(r.text)) + [None]) for r in d.collect()]
    p, uni, followers = brute_katz([w for i, w in rows if zlib.crc32(str(i).encode()) % 5 != 1], order)
    total, vocab = sum(uni.values()), len(uni)
    for m in range(1, order):  # exactly normalised at every length
        for h in [("^",) * m, *list(followers[m])[:: max(1, len(followers[m]) // 12)]]:
            assert sum(p(h, w) for w, in uni) + p(h, "never seen") == pytest.approx(1)
    for i, w in rows:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum((x,) in uni for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x,] + 0.5) / (total + 0.5 * (vocab + 1))) for x in w))
        padded = ["^"] * (order - 1) + w
        assert r.score == pytest.approx(sum(math.log10(p(tuple(padded[k : k + order - 1]), x)) for k, x in enumerate(w)))


def test_katz_scores_a_second_corpus_by_stored_tables(spark, docs, tmp_path):
    learn, other = docs.where("doc_id < 80"), docs.where("doc_id between 60 and 119")
    katz.train(learn, 3, size=40_000, tokens=20_000).save(str(tmp_path / "model"))
    model = katz.Model.load(spark, str(tmp_path / "model"))
    assert model.order == 3
    got = {r.doc_id: r for r in model.score(other, size=30_000).collect()}
    want = katz.score(docs.where("doc_id < 120"), F.col("doc_id") >= 80, 3).where("doc_id >= 60").collect()
    assert len(got) == len(want) > 30
    for r in want:
        assert got[r.doc_id].score == pytest.approx(r.score) and got[r.doc_id].train_tokens == r.train_tokens


def test_katz_splits_frequent_histories(spark, docs, tmp_path):
    d = docs.where("doc_id < 120")
    want = {r.doc_id: r for r in katz.score(d, F.col("doc_id") >= 80, 3).collect()}
    got = katz.score(d, F.col("doc_id") >= 80, 3, size=40_000, tokens=200).collect()
    katz.train(d.where("doc_id < 80"), 3, size=40_000, tokens=200).save(str(tmp_path / "model"))
    model = katz.Model.load(spark, str(tmp_path / "model"))
    parts = [r.n for r in model.tables.where(F.col("kind") == katz.SPLIT).groupBy("family").agg(F.countDistinct("bucket").alias("n")).collect()]
    assert len(parts) == 2 and min(parts) > 1  # histories of one and of two words, in several buckets
    again = model.score(d.where("doc_id >= 80"), size=30_000).collect()
    assert len(got) == len(want) and len(again) == sum(r.held_out for r in want.values()) > 30
    for r in got + again:
        assert r.score == pytest.approx(want[r.doc_id].score) and r.train_tokens == want[r.doc_id].train_tokens


def test_katz_keeps_one_state_on_disk(spark, docs):
    """What is sent and what stays in the scratch folder, beside the bytes of the texts."""

    def sent():
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    def kept():
        folder = Path(scratch_dir(spark).removeprefix("file:"))
        return {f: f.stat().st_size for f in folder.rglob("*.parquet")}

    text = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before, there = sent(), kept()
    assert katz.score(docs, F.lit(False)).count() == docs.count()
    left = {f: n for f, n in kept().items() if f not in there}
    assert len({f.parent for f in left if f"kind={katz.ANSWER}" in str(f)}) == 1  # of the last length only
    assert sent() - before + sum(left.values()) < 5 * text


def test_katz_edge_cases(spark, odd):
    got = katz.score(odd, F.lit(False)).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (1, 2, 5)} == {1}
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got) and any(r.doc_id is None for r in got)
    assert {r.score for r in katz.score(odd, F.lit(True)).collect()} == {0.0}
    assert katz.score(odd.limit(0), F.lit(False)).count() == 0
