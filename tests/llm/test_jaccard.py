"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF
from tidemark.llm import jaccard, simhash


def brute_set(text):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_components(texts):
    ids = sorted(texts)
    sets, root = {i: brute_set(texts[i]) for i in ids}, {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


def near_copies(seed, n=40, copies=5):
    """Texts of which each has copies with some words changed, similar by 0.6 to 1."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 9000, int(rng.integers(3, 400)))]
        for _ in range(copies):
            other = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 2 + len(words) // 25))):
                other[at] = f"W{rng.integers(0, 9000)}"
            out.append(" ".join(other))
    return dict(enumerate(out))


@pytest.mark.parametrize("block", [jaccard.BLOCK, 600])
def test_components_equal_all_pairs(spark, block):
    texts = near_copies(7) | {1000: None, 1001: "", 1002: " \n", 1003: "one two", 1004: "One  two"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(d, block).collect()}
    want = brute_components(texts)
    assert got == want and 50 < len(set(want.values())) < 180


def test_stage_leaves_no_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()} | {10**6 + i: t for i, t in near_copies(8, 10).items()}
    more = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    kept = corpus_pipeline.simhash_near_dedup(spark, more, SF)
    assert {r.doc_id for r in kept.collect()} == set(brute_components(texts).values())


def test_stage_takes_fingerprints_within_three_bits(spark, monkeypatch):
    """Without the keys of minima the pivot tables alone find long texts of which a few words differ."""
    rng = np.random.default_rng(9)
    texts = {}
    for i in range(20):
        words = [f"w{x}" for x in rng.integers(0, 9000, 3000)]
        texts[i] = " ".join(words)
        texts[100 + i] = " ".join([*words[:1500], "changed", *words[1501:]])
    marks = {i: simhash.majority([jaccard.shingles(t.encode())]) for i, t in texts.items()}
    near = {100 + i for i in range(20) if (marks[i] ^ marks[100 + i]).bit_count() <= 3}
    assert len(near) > 15 and any(marks[i] != marks[i - 100] for i in near)
    monkeypatch.setattr(jaccard, "minhash_keys", lambda nodes: jaccard.simhash_keys(nodes.limit(0)))
    kept = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), SF)
    assert {r.doc_id for r in kept.collect()} == set(texts) - near
