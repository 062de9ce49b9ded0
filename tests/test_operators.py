"""Properties that no single SQL statement states: folds, plans, round trips, streams."""

import bisect
import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import health, integrity, keyed, namespace, oplog
from tidemark.plans import catalogue
from tidemark.sources import sinks, text
from tidemark.sources import tables as t
from tidemark.streaming import batch, live
from tests.conftest import SF


def test_adler_in_sql_equals_zlib(spark):
    data = [b"", b"a", b"\xff" * 3000, bytes(range(256)) * 20, None]
    rows = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(data)], "i int, d binary")
    got = rows.select("i", scalar.adler32("d").alias("a"), integrity.adler32_fast("d").alias("b")).orderBy("i").collect()
    want = [zlib.adler32(x) if x is not None else None for x in data]
    assert [r.a for r in got] == want and [r.b for r in got] == want
    part = rows.where("i = 2").select(scalar.adler32(F.col("d"), zlib.adler32(b"start")).alias("a")).first().a
    assert part == zlib.adler32(data[2], zlib.adler32(b"start"))


def test_ranges_are_disjoint_and_cover(spark):
    plan = catalogue.QUERIES["range_plan"](spark, SF).toPandas()
    for _, p in plan.groupby("part"):
        p = p.sort_values("task")
        assert (p["low"] < p["high"]).all() and (p["high"].values[:-1] == p["low"].values[1:]).all()
    assigned = catalogue.QUERIES["range_assign"](spark, SF).agg(F.sum("n")).first()[0]
    assert assigned == t.records(spark, SF).count()


def test_dedup_is_idempotent(spark):
    r = t.records(spark, SF)
    once = keyed.drop_duplicate_records(r.unionByName(r))
    assert once.count() == r.count() == keyed.drop_duplicate_records(once).count()


def test_partition_out_of_range_fails(spark):
    with pytest.raises(Exception, match="out of range"):
        keyed.validate_partitions(t.records(spark, SF), 3).agg(F.sum("part")).collect()


def test_overflow_index_blocks(spark):
    r = spark.createDataFrame([(0, 1, i, f"k{i:03d}", 0.0, n) for i, n in enumerate([60, 30, 20, 90, 100, 10, 5])], "part int, attempt long, seq long, key string, qty double, rec_len long")
    got = keyed.overflow_index(r, 100).orderBy("rec_no").toPandas()
    assert got["rec_no"].tolist() == [0, 2, 3, 4, 5, 6] and got["offset"].tolist() == [0, 90, 110, 200, 300, 310]


def test_packed_records_stay_in_their_chunk(spark):
    got = keyed.pack_into_chunks(t.records(spark, SF), 1024).toPandas()
    assert (got["offset"] // 1024 == (got["offset"] + got["rec_len"] - 1) // 1024).all()


def test_replay_equals_a_plain_model(spark):
    """A seeded run of random operations, the model a dictionary; a prefix plus the rest gives the whole."""
    rng = random.Random(7)
    lines, files, names = [], {}, {}
    for n in range(1500):
        tree, op = rng.randrange(4), rng.choices(["create", "remove", "rename", "size", "setmtime", "setrep"], [30, 10, 10, 20, 20, 10])[0]
        name, fid = f"n{rng.randrange(12)}", 10_000 + n
        if op == "create":
            lines.append((tree, n, f"create/dir/{tree}/name/{name}/id/{fid}/numReplicas/3/ctime/{n}"))
            files.pop(names.get((tree, name)), None)
            names[tree, name] = fid
            files[fid] = [name, 3, n, n, None]
        elif op == "remove":
            lines.append((tree, n, f"remove/dir/{tree}/name/{name}"))
            files.pop(names.pop((tree, name), None), None)
        elif op == "rename":
            new = f"n{rng.randrange(12)}"
            lines.append((tree, n, f"rename/dir/{tree}/old/{name}/new/{new}"))
            if (tree, name) in names:
                moved = names.pop((tree, name))
                files.pop(names.get((tree, new)), None)
                names[tree, new] = moved
                files[moved][0] = new
        else:
            mine = [f for (k, _), f in names.items() if k == tree] or [1]
            f, v = rng.choice(mine), rng.randrange(1, 9)
            tag, at = {"size": ("filesize", 4), "setmtime": ("mtime", 3), "setrep": ("replicas", 1)}[op]
            lines.append((tree, n, f"{op}/file/{f}/{tag}/{v}"))
            if f in files:
                files[f][at] = v
    ops = oplog.parse(spark.createDataFrame(lines, "tree long, seqno long, line string"))
    got = {r.fid: [r.name, r.replicas, r.ctime, r.mtime, r.filesize] for r in oplog.replay(ops).collect()}
    assert got == files
    late = ops.where("seqno >= 1400 and op in ('size', 'setmtime', 'setrep')")
    kept = ops.join(late.select("seqno"), "seqno", "left_anti")
    settled = {r.fid: [r.name, r.replicas, r.ctime, r.mtime, r.filesize] for r in oplog.compact(oplog.replay(kept.where("seqno < 1400")), late).collect()}
    early = oplog.replay(ops.where("seqno < 1400 or op in ('size', 'setmtime', 'setrep')"))
    assert settled == {r.fid: [r.name, r.replicas, r.ctime, r.mtime, r.filesize] for r in early.collect()}


def test_parent_size_is_the_sum_of_its_children(spark):
    n = t.nodes(spark, SF)
    total = {r.fid: r.bytes for r in namespace.directory_totals(n, t.ROOT).collect()}
    children = n.groupBy("parent").agg(F.collect_list(F.struct("fid", "type", "size")).alias("c")).collect()
    for r in children:
        assert total[r.parent] == sum(total[c.fid] if c.type == "dir" else c["size"] for c in r.c)


def test_rebalance_plan_holds_its_limits(spark):
    r, s = t.replicas(spark, SF), t.servers(spark, SF)
    plan = catalogue.QUERIES["rebalance_plan"](spark, SF).toPandas()
    band = {x.server: x.band for x in health.utilisation_bands(s).collect()}
    have = {(x.chunk_id, x.server) for x in r.collect()}
    assert len(plan) and all(band[m.src] == "over" and band[m.dst] == "under" for m in plan.itertuples())
    assert all((m.chunk_id, m.src) in have and (m.chunk_id, m.dst) not in have for m in plan.itertuples())
    go = catalogue.QUERIES["rebalance_execute"](spark, SF).toPandas()
    assert (go.groupby("dst").size() <= 5).all() and (go.groupby("src").size() <= 10).all()


def test_empty_tables_and_nulls(spark):
    none = spark.createDataFrame([], "chunk_id long, server long")
    chunks = spark.createDataFrame([(1, 1, 0, 1, 5)], "chunk_id long, fid long, offset long, version long, size long")
    assert health.fsck_counts(chunks, none).first().asDict() == {"n_chunks": 1, "lost": 1, "endangered": 0}
    assert health.fsck_counts(chunks.limit(0), none).first().n_chunks == 0
    names = spark.createDataFrame([(None,), ("",), ("a/b",), ("x.tmp.y",)], "name string")
    got = names.select(scalar.legal_name("name").alias("l"), scalar.worm_allows("name").alias("w")).collect()
    assert [(r.l, r.w) for r in got] == [(False, False), (False, False), (False, False), (True, True)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "net").write_text("h1 20000 3 100 40\nh2 20000 4 50 50\n")
    assert [tuple(r) for r in text.network_definition(spark, str(tmp_path / "net")).collect()] == [("h1", 20000, 3, 100, 40), ("h2", 20000, 4, 50, 50)]
    (tmp_path / "map").write_text("7 1 2 h1 20000 3 h2 20000 4\n8 1 0\n")
    assert [tuple(r) for r in text.chunk_map(spark, str(tmp_path / "map")).collect()] == [(7, 1, "h1", 20000, 3), (7, 1, "h2", 20000, 4)]
    d = spark.createDataFrame([("drive 1",), ("64 5.6.7",)], "value string")
    assert tuple(text.parse_drive_listing(d).first()) == (65536, 5, 6, 7)
    s = spark.createDataFrame([("s=h1, p=20000\ts=h2, p=20001",)], "value string")
    assert [r.status for r in text.parse_status(s).collect()] == [{"s": "h1", "p": "20000"}, {"s": "h2", "p": "20001"}]
    (tmp_path / "conf").write_text("# c\na = 1\nb.c=x y # z\n")
    assert text.properties(spark, str(tmp_path / "conf")) == {"a": "1", "b.c": "x y"}


def test_sinks_round_trip(spark, tmp_path):
    r = t.records(spark, SF)
    sinks.write_sorted_runs(r, str(tmp_path / "runs"), 8)
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert back.count() == r.count()
    lines = oplog.checkpoint_lines(t.nodes(spark, SF), t.chunks(spark, SF))
    sinks.write_lines(lines, str(tmp_path / "cp"))
    assert oplog.restore(spark.read.text(str(tmp_path / "cp")).toDF("line")).count() == t.nodes(spark, SF).count()


def test_streams_over_many_batches_equal_their_batch_twins(spark, tmp_path):
    e = t.events(spark, SF).select(F.col("user_id").alias("owner"), F.col("us").alias("at"), F.col("event_id").alias("id"), (F.day("ts") - 1).cast("long").alias("round"), F.col("value").alias("timetaken")).toPandas().sort_values("at")
    for n in range(4):  # files in the order of time
        part = e.iloc[len(e) * n // 4 : len(e) * (n + 1) // 4]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = live.read_stream(spark, str(tmp_path / "in"), schema, 1)
    got = live.current_leases(live.drain(live.leases(stream.select("owner", "at"), 43200000000), "update")).toPandas()
    want = batch.lease_islands(spark.createDataFrame(e[["owner", "at", "id"]]), 43200000000).toPandas()
    key = ["owner", "start_at", "last_at", "n"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))
    stream = live.read_stream(spark, str(tmp_path / "in"), schema, 1)
    got = live.ewma_at(live.drain(live.slow_nodes(stream.select(F.col("owner").alias("target"), "round", "timetaken")), "update"), 31).toPandas()
    want = batch.slow_nodes(spark.createDataFrame(e).select(F.col("owner").alias("target"), F.col("round").cast("int").alias("round"), "timetaken"), 31).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("target").reset_index(drop=True), want.sort_values("target").reset_index(drop=True))


def chain(spark, n):
    """A chain of n directories with a file in each."""
    dirs = [(10 + i, 2 if i == 0 else 9 + i, f"d{i}", "dir", 0, i) for i in range(n)]
    files = [(10_000 + i, 10 + i, f"f{i}", "file", 1, 1000 + i) for i in range(n)]
    return spark.createDataFrame(dirs + files, "fid long, parent long, name string, type string, size long, mtime long")


def test_directories_of_any_depth(spark):
    n = 200
    nodes = chain(spark, n)
    totals = {r.fid: (r.bytes, r.n_files) for r in namespace.directory_totals(nodes, 2).collect()}
    assert totals == {2: (n, n)} | {10 + i: (n - i, n - i) for i in range(n)}
    found = {r.fid: r.path for r in namespace.paths(nodes, 2).collect()}
    way = ["/" + "/".join(f"d{j}" for j in range(i + 1)) for i in range(n)]
    assert found == {10 + i: way[i] for i in range(n)} | {10_000 + i: f"{way[i]}/f{i}" for i in range(n)}
    wanted = spark.createDataFrame([(way[-1] + f"/f{n - 1}",), (way[150],), (way[150] + "/none",)], "path string")
    assert {(r.path, r.fid) for r in namespace.lookup_paths(nodes, wanted, 2).collect()} == {(way[-1] + f"/f{n - 1}", 10_000 + n - 1), (way[150], 160)}
    below = {r.fid for r in namespace.set_replication(nodes, nodes.where("fid = 100"), F.lit(2), 2).collect()}
    assert below == {10_000 + i for i in range(90, n)}


def test_a_cycle_of_directories_fails(spark):
    nodes = spark.createDataFrame([(10, 11, "a", "dir", 0, 0), (11, 10, "b", "dir", 0, 0)], "fid long, parent long, name string, type string, size long, mtime long")
    with pytest.raises(ValueError, match="cycle"):
        namespace.directory_paths(nodes, 2)
    with pytest.raises(ValueError, match="cycle"):
        namespace.closure(nodes, 2)


def test_positions_of_a_hot_key(spark):
    rows = [(0, "k" if i % 3 else f"a{i}", i) for i in range(3000)] + [(1, "z", i) for i in range(10)]
    got = keyed.positions(spark.createDataFrame(rows, "part int, key string, i long"), "part", "key").toPandas()
    for _, g in got.groupby("part"):
        g = g.sort_values("pos")
        assert g["pos"].tolist() == list(range(len(g))) and g["key"].is_monotonic_increasing


def test_merge_check_finds_what_it_should(spark):
    r = spark.createDataFrame([(0, "b", 0), (0, "a", 1), (0, "c", 2)], "part int, key string, at int")
    assert keyed.order_violations(r, F.col("at"), "part").first().n_violations == 1


def test_rebalance_serves_all_over_used_servers(spark):
    servers = spark.createDataFrame([(1, 1, 900, 1000, 0.9), (2, 1, 880, 1000, 0.88), (3, 2, 500, 1000, 0.5), (4, 2, 760, 1000, 0.76)], "server long, rack int, used long, total long, util double")
    replicas = spark.createDataFrame([(c, s) for s in (1, 2) for c in range(s * 1000, s * 1000 + 80)] + [(2000, 3), (1001, 3), (1000, 2)], "chunk_id long, server long")
    sizes = replicas.select("chunk_id", F.lit(10).cast("long").alias("size")).distinct()
    moves = health.rebalance_plan(replicas, sizes, servers).toPandas()
    assert set(moves["src"]) == {1, 2} and set(moves["dst"]) == {3}
    assert not moves["chunk_id"].isin([1001, 2000]).any() and not moves.duplicated(["chunk_id", "dst"]).any()
    assert (moves.groupby("src").size() * 10 >= pd.Series({1: 140, 2: 120}) - 40).all()


def test_copies_of_a_retiring_server_stay(spark):
    replicas = spark.createDataFrame([(c, s) for c in (1, 2) for s in range(5)] + [(2, 9)], "chunk_id long, server long")
    servers = spark.createDataFrame([(s, s, 0.1 * s) for s in range(10)], "server long, rack int, util double")
    gone = health.excess(replicas, servers, retiring=servers.where("server = 9")).collect()
    assert {(r.chunk_id, r.server) for r in gone} == {(1, 3), (1, 4)}


def test_logs_in_order_of_number_and_place(spark, tmp_path):
    for n in (9, 10, 2):
        (tmp_path / f"log.{n}").write_text("".join(f"{n}-{i}\n" for i in range(200)))
    got = oplog.read_log(spark, str(tmp_path), since=9).orderBy("log_no", "block", "line_no").collect()
    assert [r.line for r in got] == [f"{n}-{i}" for n in (9, 10) for i in range(200)]


def test_names_replay_with_errors_as_a_model(spark):
    """Nested directories, renames over directories and into descendants, against a plain tree."""
    rng = random.Random(11)
    ops, tops = [], (1, 2)
    for n in range(400):
        top = rng.choice(tops)
        where = rng.choice([top] + [o["id"] for o in ops if o["op"] == "mkdir" and o["tree"] == top][-4:])
        kind, name = rng.choice(["create", "create", "mkdir", "mkdir", "remove", "rmdir", "rename", "rename"]), rng.choice("abcd")
        ops.append({"tree": top, "seqno": f"{n:05d}", "op": kind, "dir": where, "name": name, "id": 100 + n, "new": rng.choice(["a", "b", "a/b", "/c/d", "/a/b/c", "x/"]), "ex": rng.randint(0, 1)})

    def line(o):
        if o["op"] == "rename":
            return None
        return f"{o['op']}/dir/{o['dir']}/name/{o['name']}/id/{o['id']}/exclusive/{o['ex']}"

    rows = [(o["tree"], o["seqno"], o["op"], {"dir": str(o["dir"]), "name": o["name"], "old": o["name"], "new": o["new"], "id": str(o["id"]), "exclusive": str(o["ex"])}) for o in ops]
    got = oplog.replay_names(spark.createDataFrame(rows, "tree long, seqno string, op string, args map<string,string>")).collect()
    tree: dict[int, dict[int, dict[str, int]]] = {t: {t: {}} for t in tops}  # directory -> name -> number; files have none of their own
    want = {}
    for o in ops:
        dirs = tree[o["tree"]]
        here, error = dirs.get(o["dir"], {}), None
        there = here.get(o["name"])
        is_dir = there in dirs
        if o["op"] in ("create", "mkdir"):
            if there is not None and (o["op"] == "mkdir" or (not is_dir and o["ex"])):
                error = "EEXIST"
            elif is_dir:
                error = "EISDIR"
            else:
                dirs.setdefault(o["dir"], {})[o["name"]] = o["id"]
                if o["op"] == "mkdir":
                    dirs[o["id"]] = {}
        elif there is None:
            error = "ENOENT"
        elif o["op"] == "remove":
            error = "EISDIR" if is_dir else here.pop(o["name"]) and None
        elif o["op"] == "rmdir":
            error = "ENOTDIR" if not is_dir else "ENOTEMPTY" if dirs[there] else None
            if not error:
                del dirs[here.pop(o["name"])]
        else:
            *way, last = o["new"].split("/")
            at = o["tree"] if way else o["dir"]
            for step in filter(None, way):
                nxt = dirs[at].get(step)
                if nxt is None or nxt not in dirs:
                    error = "ENOENT" if nxt is None else "ENOTDIR"
                    break
                at = nxt
            if not error and not last:
                error = "EINVAL"
            if not error and (at, last) != (o["dir"], o["name"]):
                old = dirs.setdefault(at, {}).get(last)

                def inside(x, top, dirs=dirs):
                    return x == top or any(inside(x, k, dirs) for k in dirs.get(top, {}).values() if k in dirs)

                if old is not None and (old in dirs) != is_dir:
                    error = "ENOTDIR" if is_dir else "EISDIR"
                elif old in dirs and dirs[old]:
                    error = "ENOTEMPTY"
                elif is_dir and inside(at, there):
                    error = "EINVAL"
                else:
                    if old in dirs:
                        del dirs[old]
                    dirs[at][last] = here.pop(o["name"])
        want[o["seqno"]] = error
    assert {r.seqno: r.error for r in got if r.seqno} == want and len(set(want.values())) >= 6
    assert sorted((r.parent, r.name, r.fid) for r in got if not r.seqno) == sorted((d, n, i) for t in tops for d, names in tree[t].items() for n, i in names.items())


def test_streams_do_not_depend_on_the_order_of_files(spark, tmp_path):
    e = t.events(spark, SF).select("user_id", "ts", "value", "us")
    e.repartition(40, F.xxhash64("us")).write.parquet(str(tmp_path / "events"))
    s = live.read_stream(spark, str(tmp_path / "events"), e.schema, files_per_trigger=5)
    samples = s.select(F.col("user_id").alias("target"), (F.day("ts") - 1).cast("long").alias("round"), F.col("value").alias("timetaken"))
    plain = e.select(F.col("user_id").alias("target"), (F.day("ts") - 1).cast("int").alias("round"), F.col("value").alias("timetaken"))
    got = live.ewma_at(live.drain(live.slow_nodes(samples), "update"), 31)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.slow_nodes(plain, 31).collect()))
    day = 43_200_000_000
    want = sorted(map(tuple, batch.lease_islands(e.select(F.col("user_id").alias("owner"), F.col("us").alias("at"), F.col("us").alias("id")), day).select("owner", "start_at", "last_at", "n").collect()))
    for keep in (None, 40 * 86_400_000_000):
        got = live.current_leases(live.drain(live.leases(s.select(F.col("user_id").alias("owner"), F.col("us").alias("at")), day, keep), "update"))
        assert sorted(map(tuple, got.collect())) == want


def _as_printf(spark, fn, sizes, shift_of):
    """Sizes whose text differs from that of C's printf (which Python's format equals)."""
    rows = spark.createDataFrame([(n,) for n in sizes] + [(None,)], "n long")
    got = {r.n: r.t for r in rows.select("n", fn("n").alias("t")).collect()}
    assert got.pop(None) is None
    want = {n: f"{n / (1 << shift_of(n)[1]):.2f} {shift_of(n)[0]}" if shift_of(n) else str(n) for n in sizes}
    return {n: (got[n], want[n]) for n in sizes if got[n] != want[n]}


def _ties(*shifts):
    """Eighths of units, which end halfway between hundredths, their neighbours, and other sizes."""
    rng = random.Random(5)
    eighths = [(8 * rng.randrange(1, 1000) + k) << (shift - 3) for shift in shifts for k in range(8) for _ in range(20)]
    return sorted({n + d for n in eighths for d in (-1, 0, 1)} | {rng.randrange(1 << rng.randrange(1, 53)) for _ in range(1000)})


def test_readable_bytes_round_as_printf(spark):
    units = (("PB", 50), ("TB", 40), ("GB", 30), ("MB", 20))
    assert not _as_printf(spark, scalar.readable_bytes, _ties(20, 30, 40), lambda n: next((u for u in units if n > 1 << u[1]), None))


def test_human_sizes_round_as_printf(spark):
    assert not _as_printf(spark, scalar.human_size, _ties(10, 20, 30), lambda n: ("KB", 10) if n < 1 << 20 else ("MB", 20) if n < 1 << 30 else ("GB", 30))


@pytest.mark.parametrize("fanout", [2, 4, 64])
def test_ranges_found_by_a_tree(spark, fanout):
    """Against bisection: keys below the first start, on starts and between, partitions of few and many ranges."""
    rng, starts, rows = random.Random(3), {}, []
    for part, n in ((0, 1), (1, 2), (2, 63), (3, 65), (4, 700)):
        starts[part] = sorted(rng.sample(range(100, 9000), n))
        rows += [(part, f"{k:05d}") for k in [*starts[part][:50], *(rng.randrange(10000) for _ in range(100))]]
    rows.append((9, "00500"))  # a partition without a plan
    plan = spark.createDataFrame([(p, i, f"{k:05d}".encode().hex().upper()) for p, ks in starts.items() for i, k in enumerate(ks)], "part int, task int, low string")
    got = keyed.assign_ranges(spark.createDataFrame(rows, "part int, key string"), plan, fanout).collect()
    want = [(p, k, bisect.bisect_right(starts[p], int(k)) - 1) for p, k in rows if p in starts and int(k) >= starts[p][0]]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_sizes_meet_in_parts_by_their_number(spark):
    there = spark.range(100).selectExpr("id AS chunk_id", "id % 7 AS fid", "'host' || id % 5 AS host", "20000 AS port", "1 AS rack")
    listing = there.where("chunk_id % 2 = 0").selectExpr("chunk_id", "fid", "host", "port", "chunk_id * 10 AS size")
    few, many = (health.with_sizes(there, listing.union(listing), n) for n in (1000, 10))
    assert sorted(few.collect()) == sorted(many.collect()) and {r.chunk_id: r.size for r in many.collect()} == {i: 0 if i % 2 else 10 * i for i in range(100)}
    assert many.rdd.getNumPartitions() > few.rdd.getNumPartitions()
