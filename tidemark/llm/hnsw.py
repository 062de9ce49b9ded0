"""Operator 2: near-duplicate embeddings by HNSW graphs, one per shard.

Vectors are normalised in double precision; null, zero, empty or non-finite ones, and rows with a
null vec_id, link with nothing. Equal vectors collapse to one with a weight, so a vector that a
third of all rows share is searched once. The distinct vectors are dealt to shards (``SHARDS``, or
as many as keep a shard under ``SHARD_ROWS``), each of which gets a hierarchical navigable
small-world graph. Every distinct vector is then searched in every shard, in blocks: greedily down
the sparse layers, then with a beam over the base layer.

Recall. Each group of searches audits its beam first: shard vectors turned by just under the
threshold's angle must lead back to their original, and real queries of a bounded sample must give
the links of an exact scan; the beam doubles until ``AUDIT`` of them are right (an exact scan of
the shard is the last resort). A query whose beam is half full of links is searched again
with a beam twice as wide, until it is not; where that would cost more than an exact scan of the
shard, as in a large group of near copies, the shard is scanned in blocks instead. Links are
verified by cosine in double precision.

Links are counted, not listed: each search returns the weighted number of links and the connected
components of the shard (found when it was built) that they touch, which is all that the union of
components over shards needs. Links in hand are those of a block of queries, never of a group, so
memory does not grow with the square of a hot group. Vectors of different lengths are never
compared.

Shuffle. A shard's graph goes once to each group of ``BLOCK * BLOCKS_A_GROUP`` queries, and each
query once to each shard: with a fixed number of shards both grow as the rows. Searching every
shard is the method; ``SHARD_ROWS`` should grow with executors' memory.

Defined cases: an empty table gives an empty result; vectors that tie, or repeat, ids included,
are each a vector of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.session import materialise, table

THRESHOLD = 0.95
SHARDS = 8
SHARD_ROWS = 16384
BLOCK = 1024
BLOCKS_A_GROUP = 32
DEGREE = 12
MOST = 32
BUILD_BEAM = 48
BEAM = 24
AUDIT = 0.99
AUDIT_ROWS = 128
#: What looking at a vector in a graph costs, in vectors of an exact scan; queries of a block of such a scan.
GRAPH_COST = 64
EXACT_BLOCK = 64
THIN = 16


# ---------------------------------------------------------------- the graph
class Graph:
    """An HNSW graph over unit vectors; ``layers[0]`` is the base layer."""

    def __init__(self, vecs: np.ndarray, seed: int = 0):
        self.vecs = np.ascontiguousarray(vecs, np.float32)
        n = len(vecs)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)  # the first n / 16**l of these make up layer l
        self.base = np.full((n, MOST), -1, np.int32)
        self.upper: list[tuple[np.ndarray, np.ndarray]] = []
        size = n // THIN
        while size > 1:
            nodes = np.sort(order[:size])
            self.upper.append((nodes, self._layer(nodes)))
            size //= THIN
        self.entry = int(order[0])
        self._build(order)

    def _layer(self, nodes: np.ndarray) -> np.ndarray:
        """Diverse neighbours in a sparse layer, as node numbers (-1: none)."""
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        k = min(len(nodes), BUILD_BEAM)
        for at in range(0, len(nodes), 512):
            own = nodes[at : at + 512]
            sims = self.vecs[own] @ self.vecs[nodes].T
            sims[np.arange(len(own)), np.arange(at, at + len(own))] = -2
            near = np.argsort(-sims, axis=1)[:, :k]
            got = self._select(nodes[near], np.take_along_axis(sims, near, 1), DEGREE, DEGREE)
            out[at : at + len(own), : got.shape[1]] = got
        return out

    def _select(self, cand: np.ndarray, sims: np.ndarray, diverse: int, most: int) -> np.ndarray:
        """Of candidates (best first; sims of -2 don't count): the diverse ones, then the nearest."""
        v = self.vecs[cand]
        among = np.einsum("bcd,bed->bce", v, v)
        good, kept, n = sims > -1.5, np.zeros(cand.shape, bool), np.zeros(len(cand), np.int32)
        closest = np.full(cand.shape, -2, np.float32)
        for c in range(cand.shape[1]):
            take = good[:, c] & (n < diverse) & (closest[:, c] < sims[:, c])
            kept[:, c] = take
            n += take
            closest = np.where(take[:, None], np.maximum(closest, among[:, c]), closest)
        rank = np.where(good, np.arange(cand.shape[1])[None, :] - 1000 * kept, 10**6)
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(good, first, 1), np.take_along_axis(cand, first, 1), -1).astype(np.int32)

    def _build(self, order: np.ndarray) -> None:
        """Insert in growing batches: beam search in the graph so far, and exactly within the batch."""
        done, degree = 0, np.zeros(len(order), np.int32)
        while done < len(order):
            batch = order[done : done + min(512, max(64, done))]
            within = self.vecs[batch] @ self.vecs[batch].T
            np.fill_diagonal(within, -2)
            cand, sims = np.broadcast_to(batch, within.shape), within
            if done:
                ids, s = self.search(self.vecs[batch], BUILD_BEAM)
                cand, sims = np.concatenate([ids, cand], 1), np.concatenate([np.where(ids < 0, -2, s), sims], 1)
            k = min(BUILD_BEAM, cand.shape[1])
            best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            got = self._select(np.take_along_axis(cand, best, 1), np.take_along_axis(sims, best, 1), DEGREE // 2, DEGREE)
            a = np.repeat(batch, got.shape[1])[got.ravel() >= 0]
            b = got.ravel()[got.ravel() >= 0]
            for x, y in zip(np.concatenate([a, b]).tolist(), np.concatenate([b, a]).tolist(), strict=True):
                row = self.base[x]
                if (row[: degree[x]] == y).any():
                    continue
                if degree[x] < MOST:
                    row[degree[x]] = y
                    degree[x] += 1
                else:
                    self._shrink(x, y, degree)
            done += len(batch)

    def _shrink(self, x: int, y: int, degree: np.ndarray) -> None:
        cand = np.append(self.base[x], np.int32(y))
        sims = self.vecs[cand] @ self.vecs[x]
        best = np.argsort(-sims)
        keep = self._select(cand[best][None], sims[best][None], MOST // 2, MOST - 8)[0]
        keep = keep[keep >= 0]
        self.base[x] = -1
        self.base[x, : len(keep)] = keep
        degree[x] = len(keep)

    # ------------------------------------------------------------ search
    def _descend(self, q: np.ndarray) -> np.ndarray:
        at = np.full(len(q), self.entry)
        best = q @ self.vecs[self.entry]
        for nodes, near in reversed(self.upper):
            moving = np.arange(len(q))
            while len(moving):
                ids = near[np.searchsorted(nodes, at[moving])]
                sims = np.where(ids < 0, -2, np.einsum("qd,qkd->qk", q[moving], self.vecs[ids]))
                j = sims.argmax(axis=1)
                top = sims[np.arange(len(moving)), j]
                better = top > best[moving]
                moving, to, top = moving[better], ids[np.arange(len(ids)), j][better], top[better]
                at[moving], best[moving] = to, top
        return at

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sims), ``beam`` wide, best first; -1 and -2 where there are fewer."""
        ids, sims = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -2, np.float32)
        step = max(1, min(256, (64 << 20) // max(1, len(self.vecs))))
        for at in range(0, len(q), step):
            ids[at : at + step], sims[at : at + step] = self._beam(q[at : at + step], beam)
        return ids, sims

    def _beam(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, wide = len(q), 3
        ids, sims, open_ = np.full((n, beam), -1, np.int32), np.full((n, beam), -2, np.float32), np.zeros((n, beam), bool)
        ids[:, 0] = self._descend(q)
        sims[:, 0] = np.einsum("qd,qd->q", q, self.vecs[ids[:, 0]])
        open_[:, 0] = True
        seen = np.zeros((n, len(self.vecs) + 1), bool)  # the last column is for -1
        seen[:, -1] = True
        seen[np.arange(n), ids[:, 0]] = True
        act = np.arange(n)
        while len(act):
            o = open_[act]
            pick = np.argsort(~o, axis=1, kind="stable")[:, : min(wide, beam)]  # the best open ones: rows are sorted
            use = np.take_along_axis(o, pick, 1)
            nodes = np.where(use, np.take_along_axis(ids[act], pick, 1), -1)
            o[np.arange(len(act))[:, None], pick] = False
            new = np.where(nodes[:, :, None] < 0, -1, self.base[nodes]).reshape(len(act), -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            fresh = ~seen[act[:, None], new]
            seen[act[:, None], new] = True
            width = int(fresh.sum(axis=1).max(initial=0))
            if width:
                front = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
                new = np.where(np.take_along_axis(fresh, front, 1), np.take_along_axis(new, front, 1), -1)
                s = np.where(new < 0, -2, np.einsum("qd,qkd->qk", q[act], self.vecs[new]))
                all_s = np.concatenate([sims[act], s], 1)
                top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
                sims[act] = np.take_along_axis(all_s, top, 1)
                ids[act] = np.take_along_axis(np.concatenate([ids[act], new], 1), top, 1)
                o = np.take_along_axis(np.concatenate([o, new >= 0], 1), top, 1)
            open_[act] = o
            act = act[o.any(axis=1)]
        return ids, sims


# ---------------------------------------------------------------- links
def exact(vecs: np.ndarray, q: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, vector) with a cosine of at least the threshold, in blocks of queries."""
    for at in range(0, len(q), EXACT_BLOCK):
        i, j = np.nonzero(q[at : at + EXACT_BLOCK] @ vecs.T >= threshold)
        yield i + at, j


def linked(g: Graph, vecs: np.ndarray, q: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, vector) links by beam search, in bounded parts; all of a query are in one part.

    A narrow beam finds the queries in dense groups: where it is half full of links it widens, up
    to where an exact scan is cheaper. The other queries are searched with ``beam``.
    """
    waiting = [(min(BEAM, beam), np.arange(len(q)))]
    while waiting:
        wide, left = waiting.pop()
        if wide >= len(vecs):
            for i, j in exact(vecs, q[left], threshold):
                yield left[i], j
            continue
        thin, dense = [], []
        for at in range(0, len(left), BLOCK):
            own = left[at : at + BLOCK]
            ids, sims = g.search(q[own].astype(np.float32), wide)
            hit = sims >= threshold - 1e-4
            full = hit.sum(axis=1) * 2 >= wide
            dense.append(own[full])
            if wide < beam:
                thin.append(own[~full])
                continue
            i, k = np.nonzero(hit & ~full[:, None])
            j = ids[i, k]
            sure = np.einsum("kd,kd->k", q[own[i]], vecs[j]) >= threshold
            yield own[i[sure]], j[sure]
        wider = len(vecs) if 2 * wide * MOST * GRAPH_COST >= len(vecs) else 2 * wide
        waiting += [(w, np.concatenate(x)) for w, x in ((beam, thin), (wider, dense)) if sum(map(len, x))]


def audited_beam(g: Graph, vecs: np.ndarray, q: np.ndarray, threshold: float, beam: int = BEAM) -> int:
    """The least beam that passes the audit (see module); at most the shard's size."""
    rng = np.random.default_rng(len(vecs))
    own = rng.permutation(len(vecs))[:AUDIT_ROWS]
    noise = rng.standard_normal((len(own), vecs.shape[1]))
    noise -= (noise * vecs[own]).sum(axis=1, keepdims=True) * vecs[own]
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    c = min(threshold + 0.002, 1.0)
    turned = c * vecs[own] + np.sqrt(1 - c * c) * noise
    real = q[rng.permutation(len(q))[:AUDIT_ROWS]]
    for tests in (turned, real):
        want = sum(len(i) for i, _ in exact(vecs, tests, threshold))
        # what a search finds is verified, so it is part of what there is
        while beam < len(vecs) and sum(len(i) for i, _ in linked(g, vecs, tests, threshold, beam)) < AUDIT * want:
            beam *= 2
    return beam


def components(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Label of each of n nodes: the smallest node reached over the links."""
    label = np.arange(n)
    for a, b in links:
        pairs = np.unique(label[a] * n + label[b])  # in a hot group soon a few
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while (up := parent.get(i, i)) != i:
                parent[i] = parent.get(up, up)
                i = up
            return i

        for x, y in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if parent:
            move = np.arange(n)
            for i in parent:
                move[i] = find(i)
            label = move[label]
    return label


# ---------------------------------------------------------------- Spark
def _unit(batches):
    """(vec_id, vec, dim): unit vectors as bytes of doubles; null where there is none."""
    for b in batches:
        vecs, dims = [], []
        for x in b.column(1):
            v = np.array([np.nan if y is None else y for y in x.as_py()] if x.is_valid else [], np.float64)
            size = float(np.max(np.abs(v), initial=0)) if np.isfinite(v).all() else np.nan
            ok = np.isfinite(size) and size > 0
            v = v / size if ok else v  # neither overflow nor underflow in the squares
            vecs.append((v / np.linalg.norm(v) + 0.0).tobytes() if ok else None)
            dims.append(len(v))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "vec", "dim"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


GRAPH_SCHEMA = "dim int, shard int, ids binary, weights binary, vecs binary, base binary, upper array<struct<nodes:binary,near:binary>>, entry int, labels binary"


def _build(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        dim, shard = t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
        t = t.sort_by("id")
        ids, vecs = np.array(t.column("id")), _matrix(t.column("vec"), dim)
        g = Graph(vecs)
        labels = ids[components(len(ids), linked(g, vecs, vecs, threshold, audited_beam(g, vecs, vecs, threshold)))]
        upper = [{"nodes": x.astype(np.int64).tobytes(), "near": y.tobytes()} for x, y in g.upper]
        row = {"dim": dim, "shard": shard, "ids": ids.tobytes(), "weights": np.array(t.column("n")).tobytes(), "vecs": vecs.tobytes(), "base": g.base.tobytes(), "upper": upper, "entry": g.entry, "labels": labels.tobytes()}
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.struct([("nodes", pa.binary()), ("near", pa.binary())])), pa.int32(), pa.binary()]
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), kinds, strict=True)})

    return run


def _stored(row: dict) -> tuple[Graph, np.ndarray]:
    g = Graph.__new__(Graph)
    vecs = np.frombuffer(row["vecs"], np.float64).reshape(-1, row["dim"])
    g.vecs, g.entry = vecs.astype(np.float32), row["entry"]
    g.base = np.frombuffer(row["base"], np.int32).reshape(-1, MOST)
    g.upper = [(np.frombuffer(u["nodes"], np.int64), np.frombuffer(u["near"], np.int32).reshape(-1, DEGREE)) for u in row["upper"]]
    return g, vecs


def _blocks(batches):
    """Blocks of queries: (block, dim, ids, vecs)."""
    for b in batches:
        dims, ids, vecs = np.array(b.column(1)), np.array(b.column(0)), b.column(2)
        for dim in np.unique(dims):
            mine = np.flatnonzero(dims == dim)
            for at in range(0, len(mine), BLOCK):
                own = mine[at : at + BLOCK]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids[own].min())], pa.int64()), pa.array([int(dim)], pa.int32()), pa.array([ids[own].tobytes()], pa.binary()), pa.array([b"".join(vecs.take(pa.array(own)).to_pylist())], pa.binary())],
                    names=["block", "dim", "ids", "vecs"],
                )


FOUND_SCHEMA = "id long, n_links long, roots array<long>"


def _search(threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"id": [], "n_links": [], "roots": []}
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            g, vecs = _stored(row)
            ids, weights, labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "weights", "labels"))
            roots, root = np.unique(labels, return_inverse=True)
            own = np.concatenate([np.frombuffer(x, np.int64) for x in right.column("ids").to_pylist()])
            q = _matrix(right.column("vecs"), row["dim"])
            for i, j in linked(g, vecs, q, threshold, audited_beam(g, vecs, q, threshold)):
                other = own[i] != ids[j]
                i, j = i[other], j[other]
                n = np.bincount(i, weights[j], len(q))  # exact up to 2**53
                pairs = np.unique(i * len(roots) + root[j])
                at, first = np.unique(pairs // len(roots), return_index=True)
                out["id"] += own[at].tolist()
                out["n_links"] += n[at].astype(np.int64).tolist()
                out["roots"] += [roots[x].tolist() for x in np.split(pairs % len(roots), first[1:])] if len(at) else []
        return pa.table({"id": pa.array(out["id"], pa.int64()), "n_links": pa.array(out["n_links"], pa.int64()), "roots": pa.array(out["roots"], pa.list_(pa.int64()))})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``.

    A row that links with nothing is its own component. Rows that repeat a vec_id are vectors of
    their own; a null vec_id gives no links and a null component, and is kept.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.mapInArrow(_unit, "vec_id long, vec binary, dim int").withColumn("key", F.when(F.col("vec_id").isNotNull(), F.md5("vec")))
    rows = materialise(rows, "vectors")
    uniq = rows.where("key is not null").groupBy("dim", "key").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    # the hash of a distinct vector names it inside; ids may repeat over different vectors
    uniq = materialise(uniq.withColumn("id", F.xxhash64("dim", "key")), "distinct")
    size = uniq.count()
    shards = max(shards, -(-size // shard_rows))
    dealt = uniq.select("dim", F.pmod("id", F.lit(shards)).cast("int").alias("shard"), "id", "n", "vec")
    graphs = materialise(dealt.groupBy("dim", "shard").applyInArrow(_build(threshold), GRAPH_SCHEMA), "graphs")
    parts = max(1, -(-size // (BLOCK * BLOCKS_A_GROUP)))
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    blocks = uniq.repartition(parts, "id").select("id", "dim", "vec").mapInArrow(_blocks, "block long, dim int, ids binary, vecs binary")
    asked = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    there = graphs.withColumn("part", F.explode(every)).groupBy("dim", "shard", "part")
    found = materialise(there.cogroup(asked.groupBy("dim", "shard", "part")).applyInArrow(_search(threshold), FOUND_SCHEMA), "found")
    edges = found.select(F.col("id").alias("a"), F.explode("roots").alias("b"))
    labels = graphs.mapInArrow(_label_edges, "a long, b long")
    roots = connected_components(edges.union(labels))
    named = uniq.select("key", "dim", "id", "low", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    links = found.groupBy("id").agg(F.sum("n_links").alias("links"))
    named = named.join(lowest, "root").join(links, "id", "left")
    named = materialise(named.select("key", "dim", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
    out = rows.select("vec_id", "key", "dim").join(named, ["key", "dim"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def _label_edges(batches):
    """Links inside a shard: each vector with its component's label there."""
    for b in batches:
        for ids, labels in zip(b.column(b.schema.get_field_index("ids")).to_pylist(), b.column(b.schema.get_field_index("labels")).to_pylist(), strict=True):
            a, c = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != c]), pa.array(c[a != c])], names=["a", "b"])


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding_near_dedup": op2_embedding_near_dedup}
SQL = {
    "op2_embedding_near_dedup": """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
    ok AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) n FROM v
           WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
    l AS (SELECT a.vec_id x, b.vec_id y FROM ok a, ok b
          WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
    r AS (SELECT vec_id x, vec_id y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
    c AS (SELECT x, min(y) component_id FROM r GROUP BY 1),
    k AS (SELECT x, count(*) n FROM l GROUP BY 1)
    SELECT vec_id, coalesce(n, 0)::BIGINT n_links, component_id, vec_id = component_id kept
    FROM v JOIN c ON vec_id = c.x LEFT JOIN k ON vec_id = k.x""",
}
