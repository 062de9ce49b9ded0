"""Secret scans of very long and odd texts: linear work, no deep recursion, whole results."""

import math
import random
import time

import pytest

from tidemark.llm import secrets

KEY = "q7Zk9PbX2mW4tR8vN1cY6sD3"


def windows(v: str, kind: str) -> tuple[int, int] | None:
    """First start and last end of the windows at or over the threshold, each counted anew."""
    w, hits = secrets.WINDOW, []
    for i in range(len(v) - w + 1):
        c = [v[i : i + w].count(x) for x in set(v[i : i + w])]
        if math.log2(w) - sum(n * math.log2(n) for n in c) / w >= secrets.THRESHOLDS[kind]:
            hits.append(i)
    return (hits[0], hits[-1] + w) if hits else None


@pytest.mark.parametrize(
    ("text", "n", "base", "entropy"),
    [
        ("ab-" * 100_000, 0, 0, 0),
        ("x" * 1_000_000, 0, 0, 0),
        ("xxxx" * 250_000, 0, 0, 0),
        ("token=abcdef\n" * 80_000, 80_000, 80_000, 0),
        (f"{KEY} " * 40_000, 0, 0, 40_000),
        (KEY * 40_000, 0, 0, 1),
    ],
    ids=["slug", "letter", "placeholder", "matches", "keys", "candidate"],
)
def test_long_texts(spark, text, n, base, entropy):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = secrets.scan_secrets(d).collect()[0]
    assert time.time() - began < 60
    kinds = [x.split(":")[0] for x in r.spans.split(",") if x]
    assert r.n_assign == n and kinds.count("entropy") == entropy and len(kinds) == base + entropy
    out = secrets.redact(d).collect()[0].text
    assert time.time() - began < 120
    assert out.count("[REDACTED]") == base + entropy and KEY not in out
    if not base + entropy:
        assert out == text


def test_entropy_equals_counting_each_window_anew(spark):
    rng = random.Random(5)
    kinds = {"decimal": "0123456789", "hex": "0123456789abcdef", "letters": "abcdefghijklmnopqrstuvwxyzQRSTUV", "alphanumeric": "abcdefXYZ0123456789mnop", "base64": "abcXYZ012789+/-_mnopqr"}
    rows = []
    for kind, letters in kinds.items():
        for k in range(60):
            few = letters[: rng.randint(3, len(letters))] + ("" if kind in ("decimal", "letters") else letters[-6:])
            v = "".join(rng.choice(few if rng.random() < 0.7 else letters) for _ in range(rng.randint(20, 23 if kind == "hex" else 70)))
            rows.append((len(rows), kind, v))
    d = spark.createDataFrame([(i, v) for i, _, v in rows], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(d).collect()}
    classes = {"decimal": str.isdigit, "hex": lambda v: set(v) <= set("0123456789abcdef") or set(v) <= set("0123456789ABCDEF"), "letters": str.isalpha, "alphanumeric": str.isalnum, "base64": lambda v: True}
    checked = 0
    for i, _, v in rows:
        if "hex" in got[i] or "assign" in got[i] or (not any(c.isdigit() for c in v) and "".join(c if c.isalpha() else " " for c in v).split() and max(map(len, "".join(c if c.isalpha() else " " for c in v).split())) <= secrets.WORD):
            continue
        want = windows(v, next(k for k, is_ in classes.items() if is_(v)))
        assert got[i] == (f"entropy:{want[0]}:{want[1]}" if want else ""), v
        checked += 1
    assert checked > 150


def test_odd_rows_and_names(spark):
    kind = "doc_id long, text string, _s_base string, _S_All int"
    rows = [(1, None, "a", 1), (2, "", "b", 2), (None, f"token={KEY}", "c", 3), (3, f"token={KEY}", "d", 4), (3, f"token={KEY}", "d", 4)]
    d = spark.createDataFrame(rows, kind)
    got = secrets.redact(d).collect()
    assert sorted((r.doc_id or 0, r.text or "", r._s_base, r._S_All) for r in got) == sorted((i or 0, "[REDACTED]" if t else "", b, a) for i, t, b, a in rows)
    scanned = secrets.scan_secrets(d).collect()
    assert len(scanned) == 5 and sorted(r.n_assign for r in scanned) == [0, 0, 1, 1, 1]
    empty = d.limit(0)
    assert secrets.scan_secrets(empty).count() == 0 and secrets.redact(empty).columns == d.columns
