"""Embeddings against all pairs, archives by exact round trip, and the pipeline."""

import base64
import hashlib
import io
import resource
import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import hnsw, warc

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    ok = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            ok[n] = x / np.linalg.norm(x)
    keys = sorted(ok)
    parent = {n: n for n in range(len(rows))}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    links = dict.fromkeys(range(len(rows)), 0)
    for a in keys:
        for b in keys:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(b)] = find(a)
    low: dict = {}
    for n in ok:
        low[find(n)] = min(low.get(find(n), rows[n][0]), rows[n][0])
    return sorted(((i, links[n], low[find(n)] if n in ok else i, i is None or i == (low[find(n)] if n in ok else i)) for n, (i, _) in enumerate(rows)), key=str)


def clustered(rng, n=1500, dim=32):
    """Random vectors, near copies of some, exact copies, and one dense group."""
    base = rng.standard_normal((n, dim))
    base[600:900] = base[:300] + 0.15 * rng.standard_normal((300, dim))
    base[900:1100] = base[5] + 0.05 * rng.standard_normal((200, dim))
    base[1100:1300] = base[7]
    return base.astype(np.float32)


def test_embeddings_equal_all_pairs(spark):
    x = clustered(np.random.default_rng(1))
    rows = [(i * 3 % 1501, v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame([(*r, 0) for r in rows], KIND)
    got = sorted(map(tuple, hnsw.near_duplicates(d, shards=3).collect()), key=str)
    want = brute(rows)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) and len(wrong) <= 0.01 * len(want)


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = clustered(rng, 1500, 24).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    beam = hnsw.audited_beam(g, x, x, 0.95)
    got, want = ({p for y in f for p in zip(*(z.tolist() for z in y), strict=True)} for f in (hnsw.linked(g, x, x, 0.95, beam), hnsw.exact(x, x, 0.95)))
    assert got <= want and len(got) >= 0.99 * len(want)


def test_hot_group_in_a_full_shard():
    """A third of a full shard are near copies: in time, in memory, and no link lost."""
    rng = np.random.default_rng(3)
    n, dim = hnsw.SHARD_ROWS, 64
    x = np.repeat(rng.standard_normal((n // 8, dim)), 8, axis=0) + 0.4 * rng.standard_normal((n, dim))  # small groups of unlike ones
    x[: n // 3] = rng.standard_normal(dim) + 0.16 * rng.standard_normal((n // 3, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    beam = hnsw.audited_beam(g, x, x, 0.95)
    counts, most = np.zeros(n, np.int64), 0
    for i, j in hnsw.linked(g, x, x, 0.95, beam):
        counts += np.bincount(i, minlength=n)
        most = max(most, len(i))
    want = np.concatenate([(x[at : at + 512] @ x.T >= 0.95).sum(axis=1) for at in range(0, n, 512)])
    assert counts.sum() >= 0.99 * want.sum() > 5_000_000 and (counts <= want).all() and most <= 2 * hnsw.EXACT_BLOCK * n
    label = hnsw.components(n, hnsw.linked(g, x, x, 0.95, beam))
    assert time.time() - began < 90 and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 1 << 20
    assert (label[: n // 3] == 0).mean() > 0.99 and (label[n // 3 :] >= n // 3).all()


def test_embedding_edge_cases(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0, 8.0]), (3, None), (4, [0.0] * 4), (5, [float("nan"), 1.0, 1.0, 1.0]), (6, [None, 1.0, 1.0, 1.0]), (7, []), (8, v[:3]), (9, v), (9, v), (None, v), (10, [float("inf")] * 4), (11, [-1.0, 2.0, 3.0, 4.0]), (12, [1e-30] * 4), (13, [1e30] * 4)]
    d = spark.createDataFrame([(*r, None) for r in rows], KIND).withColumns({c: F.lit(1) for c in ("key", "id", "n", "shard")})
    assert sorted(map(tuple, hnsw.near_duplicates(d).collect()), key=str) == brute(rows)
    assert hnsw.near_duplicates(d.limit(0)).count() == 0


# ---------------------------------------------------------------- archives
@pytest.fixture(scope="module")
def pages(spark):
    real = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    more = [(9001, "u", "same"), (9000, None, "same"), (9002, "a b\r\nc", "same"), (9003, "v", None), (9004, "v", ""), (None, "w", "alone"), (9005, "x", "é" * 5), (9006, "x", "y" * 300_000), (9000, "again", "same"), (9000, "other", "not the same")]
    return real.union(spark.createDataFrame(more, "page_id long, url string, html string"))


def wanted(rows):
    first: dict = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    out = []
    for r in rows:
        data = (r.html or "").encode()
        low = first.get(r.html or "", r.page_id)
        out.append((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if r.page_id == low else "revisit", None if r.page_id == low else low))
    return sorted(out, key=str)


def test_warc_round_trip(spark, pages):
    bundles = warc.write_bundles(pages)
    assert sorted(map(tuple, warc.read_back(bundles).collect()), key=str) == wanted(pages.collect())
    texts = {(r.page_id, r.html or "") for r in pages.collect()}
    for b in bundles.collect():  # any reader of Zstandard sees the records, the seek table is skipped
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(b.content), read_across_frames=True).read()
        frames = warc.read_seek_table(b.content)
        assert sum(f[2] for f in frames) == len(plain) and sum(f[1] for f in frames) + 8 + 9 + 8 * len(frames) == len(b.content)
        for _, head, body in warc.parse(plain):
            if head["WARC-Type"] == "response":
                i = head["WARC-Record-ID"][10:-1]
                assert (int(i) if i else None, body.decode()) in texts


def test_warc_random_access(spark, pages):
    bundles = warc.write_bundles(pages)
    ids = spark.createDataFrame([(9005,), (9002,), (3,), (77777,)], "page_id long")
    got = {r.page_id: list(warc.parse(r.record)) for r in warc.fetch(bundles, ids).collect()}
    assert set(got) == {9005, 9002, 3} and all(len(x) == 1 for x in got.values())
    assert got[9005][0][2] == ("é" * 5).encode() and got[9002][0][1]["WARC-Refers-To"] == "<urn:page:9000>"


def test_warc_revisits_only_from_a_size_on_and_empty_tables(spark, pages):
    kinds = {(r.page_id, r.record_type) for r in warc.read_back(warc.write_bundles(pages, 5)).collect()}
    assert {(9001, "response"), (9004, "response")} <= kinds
    assert warc.read_back(warc.write_bundles(pages.limit(0))).count() == 0
    assert warc.read_seek_table(warc.seek_table([])) == []


def test_damage_is_noticed():
    w = warc.Writer()
    w.add(1, warc.record(1, "u", b"x" * 100, None))
    content = w.finish()
    with pytest.raises(ValueError):
        warc.read_seek_table(content[:-1] + b"\0")
    frame = warc.read_frame(content, warc.read_seek_table(content)[0])
    with pytest.raises(ValueError):
        list(warc.parse(frame.replace(b"Content-Length: 100", b"Content-Length: 099")))


# ---------------------------------------------------------------- the pipeline and the SQL
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "mix_sources"]
    from tests.llm.test_jaccard import brute_components
    from tidemark.llm import decontaminate, secrets

    start = docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for n, (name, stage) in enumerate(p.STAGES):
        before, docs = docs, stage(spark, docs, SF).cache()
        if n < len(p.STAGES) - 1:
            assert docs.columns == start.columns and docs.count() <= before.count()
        if name == "simhash_near_dedup":
            firsts = set(brute_components({r.doc_id: r.text for r in before.collect()}).values())
            assert {r.doc_id for r in docs.collect()} == firsts and docs.count() < before.count()
        if name == "benchmark_decontamination":
            bad = {r.doc_id for r in decontaminate.scan(before, bench).where("n_hit > 0").collect()}
            assert bad and {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - bad
        if name == "secret_scan":
            assert docs.count() == before.count() and secrets.scan_secrets(docs).where("n_assign + n_access + n_hex > 0").count() == 0
    rows = p.run(spark, SF).select("doc_id", "copy", "text").collect()
    assert sorted(map(tuple, rows)) == sorted((r.doc_id, r.copy, r.text) for r in docs.collect())


def test_queries_equal_their_sql(spark):
    import duckdb

    from tests.test_queries import TABLES, plain
    from tidemark.llm import registry

    duck = duckdb.connect()
    for name in TABLES:
        duck.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    assert [sum(k.startswith(f"op{n}_") for k in registry.QUERIES) for n in range(1, 11)] == [1] * 10
    for name, sql in registry.SQL.items():
        ours, theirs = plain(registry.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(sql).df())
        assert ours.equals(theirs), name
