"""Placement and health of replicated chunks: checks, needs, stale copies, placement, rebalancing.

``replicas(chunk_id, server)``, ``servers(server, rack, used, total, util)``,
``chunks(chunk_id, fid, offset, version, size)``. Random choices are ranks by stated columns, so
plans are the same in every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import materialise

MAX_UTIL = 0.9
TARGET = 3


def replica_counts(chunks: DataFrame, replicas: DataFrame) -> DataFrame:
    """``(chunk_id, fid, n)``, chunks without a replica included."""
    n = replicas.groupBy("chunk_id").agg(F.count_distinct("server").alias("n"))
    return chunks.select("chunk_id", "fid").join(n, "chunk_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def fsck_counts(chunks: DataFrame, replicas: DataFrame) -> DataFrame:
    c = replica_counts(chunks, replicas)
    return c.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("n") == 0).alias("lost"), F.count_if(F.col("n") == 1).alias("endangered"))


def fsck_files(chunks: DataFrame, replicas: DataFrame) -> DataFrame:
    """Files of lost and endangered chunks, once a chunk."""
    c = replica_counts(chunks, replicas).where("n < 2")
    return c.select("fid", "chunk_id", F.when(F.col("n") == 0, "lost").otherwise("endangered").alias("state"))


def fast_fsck(chunks: DataFrame, replicas: DataFrame, servers: DataFrame) -> DataFrame:
    """One row: missing, under and over replicated against three copies, and rack faults.

    Three copies on one rack count once; else neighbours in the ordered list on the same rack do.
    """
    r = replicas.join(servers.select("server", "rack"), "server").groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("server", "rack"))), lambda x: x.rack).alias("racks"))
    c = chunks.select("chunk_id").join(r, "chunk_id", "left").withColumn("racks", F.coalesce("racks", F.array().cast("array<int>")))
    c = c.withColumn("n", F.size("racks")).withColumn("one_rack", (F.col("n") == 3) & (F.size(F.array_distinct("racks")) == 1))
    pairs = F.size(F.filter(F.zip_with(F.slice("racks", 1, F.greatest(F.col("n") - 1, F.lit(0))), F.slice("racks", 2, F.greatest(F.col("n") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    c = c.withColumn("pairs", F.when(F.col("one_rack") | (F.col("n") < 2), 0).otherwise(pairs))
    return c.agg(
        F.count_if(F.col("n") == 0).alias("missing"), F.count_if(F.col("n").between(1, 2)).alias("under"), F.count_if(F.col("n") > 3).alias("over"),
        F.count_if("one_rack").alias("one_rack"), F.sum("pairs").cast("long").alias("same_rack_pairs"), F.when(F.count_if(F.col("n") == 0) > 0, "CORRUPT").otherwise("HEALTHY").alias("status"),
    )


def replica_check(chunks: DataFrame, hosted: DataFrame, servers: DataFrame, target: int = TARGET) -> DataFrame:
    """Faults a chunk; ``hosted(chunk_id, server, size)``. Missing: no copy, or all of size zero."""
    h = hosted.join(servers.select("server", "rack"), "server").groupBy("chunk_id").agg(
        F.count("*").alias("n"), F.count_distinct("server").alias("n_servers"), F.count_distinct("rack").alias("n_racks"),
        F.min("size").alias("least"), F.max("size").alias("most"), F.count_if(F.col("size") == 0).alias("n_zero"))
    c = chunks.select("chunk_id").join(h, "chunk_id", "left").fillna(0, ["n", "n_servers", "n_racks", "n_zero"])
    return c.select(
        "chunk_id", ((F.col("n_racks") < F.least("n_servers", F.lit(target))) & (F.col("n") > 0)).alias("same_rack"), (F.col("n") < target).alias("under"),
        (F.col("n_servers") < F.col("n")).alias("same_server"), F.coalesce(F.col("least") != F.col("most"), F.lit(False)).alias("sizes_differ"),
        (F.col("n_zero") > 0).alias("zero_size"), (F.col("n") == F.col("n_zero")).alias("missing"),
    )


def replication_need(state: DataFrame) -> DataFrame:
    """``extra`` and ``action`` for ``state(chunk_id, have, retiring, target, leased, valid_lease, stable, in_file)``."""
    want = F.col("target") + F.col("retiring")
    extra = F.when((F.col("retiring") == 0) | (F.col("have") <= want), want - F.col("have")).otherwise(0)
    gone = (F.col("have") == 0) | ~F.col("in_file")
    wait = F.col("leased") | ~F.col("stable") | ((extra < 0) & F.col("valid_lease"))
    return state.select(
        "chunk_id", F.when(gone, 0).otherwise(extra).cast("long").alias("extra"),
        F.when(gone, "drop").when(wait, "wait").when(extra > 0, "replicate").when(extra < 0, "delete").otherwise("none").alias("action"),
    )


def prioritised(chunks: DataFrame, replicas: DataFrame, target: int = TARGET) -> DataFrame:
    """Chunks to replicate: ``(chunk_id, n, class)``, those with a single copy in class 0, which goes first."""
    c = replica_counts(chunks, replicas).where((F.col("n") > 0) & (F.col("n") < target))
    return c.select("chunk_id", "n", F.when(F.col("n") == 1, 0).otherwise(1).alias("class"))


def excess(replicas: DataFrame, servers: DataFrame, target: int = TARGET, retiring: DataFrame | None = None) -> DataFrame:
    """Copies to delete: the ``target`` least used are kept, one a rack first if that many racks have one.

    While one of its servers is ``retiring(server)``, no copy of a chunk is deleted.
    """
    if retiring is not None:
        busy = replicas.join(retiring.select("server"), "server", "left_semi").select("chunk_id").distinct()
        replicas = replicas.join(busy, "chunk_id", "left_anti")
    r = replicas.join(servers.select("server", "rack", "util"), "server")
    by = (F.col("util"), F.col("server"))
    r = r.withColumn("n", F.count("*").over(W.partitionBy("chunk_id"))).where(F.col("n") > target)
    r = r.withColumn("in_rack", F.row_number().over(W.partitionBy("chunk_id", "rack").orderBy(*by)))
    r = r.withColumn("n_racks", F.sum((F.col("in_rack") == 1).cast("int")).over(W.partitionBy("chunk_id")))
    first = F.when(F.col("n_racks") == target, F.col("in_rack") > 1).otherwise(F.lit(False))
    r = r.withColumn("rank", F.row_number().over(W.partitionBy("chunk_id").orderBy(first, *by)))
    return r.where(F.col("rank") > target).select("chunk_id", "server")


def stale_replicas(reported: DataFrame, chunks: DataFrame) -> DataFrame:
    """``reported(server, chunk_id, fid, version)`` with a reason where a copy is stale or behind."""
    c = chunks.select("chunk_id", F.col("fid").alias("_fid"), F.col("version").alias("_v"))
    j = reported.join(c, "chunk_id", "left")
    why = (
        F.when(F.col("_v").isNull(), "no mapping").when(F.col("_fid") != F.col("fid"), "not in file")
        .when(F.col("_v") > F.col("version"), "old version").when(F.col("_v") < F.col("version"), "reset")
    )
    return j.select("server", "chunk_id", why.alias("reason")).where("reason is not null")


def hosted_by(replicas: DataFrame, gone: DataFrame) -> DataFrame:
    """Copies on the servers of ``gone(server)``: to evacuate, or touched by their loss."""
    return replicas.join(gone.select("server"), "server", "left_semi").select("server", "chunk_id")


def not_in(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    return a.join(b.select(*by), list(by), "left_anti")


def also_in(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    return a.join(b.select(*by), list(by), "left_semi")


def delayed_until(down: DataFrame, sleeping: DataFrame, now: int, delay: int = 600, grace: int = 15) -> DataFrame:
    """When chunks of ``down(server, last_heard)`` are copied anew: planned sleeps last to their end.

    ``sleeping(server, until)``; else ``delay`` from the last heartbeat if over ``grace`` is left.
    """
    d = down.join(sleeping, "server", "left").withColumn("left", F.lit(delay) - (F.lit(now) - F.col("last_heard")))
    at = F.when(F.col("until") > now, F.col("until")).when(F.col("left") > grace, F.col("last_heard") + delay).otherwise(F.lit(now))
    return d.select("server", at.alias("start_at"))


def candidate_servers(servers: DataFrame, need: int) -> DataFrame:
    """Servers ``(server, rack, util, free)`` that may take a chunk of ``need``; over-used ones are out.

    So are those that do not answer, retire or are about to restart, where ``servers`` has the
    flags ``responsive``, ``retiring`` and ``restarting``.
    """
    free = F.col("total") - F.col("used")
    able = (free >= need) & (F.col("util") <= MAX_UTIL)
    for flag, wanted in (("responsive", True), ("retiring", False), ("restarting", False)):
        if flag in servers.columns:
            able &= F.coalesce(F.col(flag), F.lit(not wanted)) == wanted
    return servers.where(able).select("server", "rack", "util", free.alias("free"))


def placement(servers: DataFrame, replicas: int, racks: int) -> DataFrame:
    """Servers for a new chunk: racks with most servers first, a fair share of copies on each."""
    c = candidate_servers(servers, 1)
    per = -(-replicas // racks)
    top = c.groupBy("rack").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rack").limit(racks)
    c = c.join(F.broadcast(top), "rack").withColumn("r", F.row_number().over(W.partitionBy("rack").orderBy("util", "server")))
    return c.where(F.col("r") <= per).select("rack", "server", "r").orderBy("r", F.desc("rack")).limit(replicas).select("rack", "server")


def rereplication_targets(chunks: DataFrame, replicas: DataFrame, servers: DataFrame, target: int = TARGET) -> DataFrame:
    """One target for each under-replicated chunk: the emptiest server of a rack without a copy.

    Where every rack has one, the emptiest server without a copy. Each rack offers its
    ``target + 1`` emptiest servers, which bounds the offers a chunk by racks x (target + 1).
    """
    need = replica_counts(chunks, replicas).where((F.col("n") > 0) & (F.col("n") < target)).select("chunk_id")
    w = W.partitionBy("rack").orderBy("util", "server")
    offers = candidate_servers(servers, 1).withColumn("r", F.row_number().over(w)).where(F.col("r") <= target + 1)
    offers = offers.agg(F.array_sort(F.collect_list(F.struct("util", "server", "rack"))).alias("offers"))  # racks x (target + 1)
    have = replicas.join(servers.select("server", "rack"), "server").groupBy("chunk_id").agg(F.collect_set("rack").alias("racks"), F.collect_set("server").alias("hosts"))
    c = need.join(have, "chunk_id").crossJoin(F.broadcast(offers))
    free = F.filter("offers", lambda o: ~F.array_contains("racks", o.rack))
    rest = F.filter("offers", lambda o: ~F.array_contains("hosts", o.server))
    return c.select("chunk_id", F.coalesce(F.get(free, F.lit(0)).server, F.get(rest, F.lit(0)).server).alias("server"))


def utilisation_bands(servers: DataFrame, band: float = 0.1) -> DataFrame:
    """``over``, ``under`` or ``within`` the mean utilisation plus or minus a tenth of it."""
    mean = servers.agg(F.avg("util").alias("mean"))
    s = servers.crossJoin(F.broadcast(mean))
    kind = F.when(F.col("util") > F.col("mean") * (1 + band), "over").when(F.col("util") < F.col("mean") * (1 - band), "under").otherwise("within")
    return s.select("server", "rack", kind.alias("band"), F.round((F.col("util") - F.col("mean")) * F.col("total")).cast("long").alias("surplus"))


def _offers(chunks: DataFrame, rooms: list[tuple[int, int]]) -> DataFrame:
    """``chunks`` with the target ``dst`` whose stretch of the summed ``rooms`` holds their place ``pos``.

    Room is cut into slots, some four a target, on which the two sides meet: a join on equality.
    """
    width, at, slots = max(1, sum(r for _, r in rooms) // (4 * len(rooms))), 0, []
    for server, room in rooms:
        slots += [(k, server, at, at + room) for k in range(at // width, (at + room - 1) // width + 1)]
        at += room
    t = chunks.sparkSession.createDataFrame(slots, "slot long, dst long, low long, high long")
    return chunks.withColumn("slot", F.expr(f"pos div {width}")).join(t, "slot").where("low <= pos and pos < high").drop("slot", "low", "high")


def with_sizes(chunk_map: DataFrame, listing: DataFrame, rows_a_task: int = 400_000) -> DataFrame:
    """``chunk_map(chunk_id, fid, host, port, ...)`` plus the ``size`` that its host lists; 0 where it lists none.

    The map is written first: its rows say in how many parts the two sides meet, so that what a
    task sorts does not grow with them.
    """
    by = ["chunk_id", "fid", "host", "port"]
    chunk_map = materialise(chunk_map, "map")
    n = chunk_map.count() // rows_a_task + 1
    sizes = listing.repartition(n, *by).groupBy(*by).agg(F.max("size").alias("size"))
    return chunk_map.repartition(n, *by).join(sizes, by, "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))


def rebalance_plan(replicas: DataFrame, sizes: DataFrame, servers: DataFrame, band: float = 0.1, least: int = 0) -> DataFrame:
    """Moves ``(chunk_id, src, dst)`` from over- to under-used servers; chunks under ``least`` stay where they are.

    A server above the mean utilisation by over ``band`` of it offers its chunks, in order, until
    they make up its surplus; servers below by that much have room up to the upper edge of the
    band. The offers stand one after the other, and so do the rooms: an offer goes to the room in
    which its place lies, so a target takes chunks as long as it has any room left. Where the
    target has the chunk already, or gets it twice, the offer is made again for what room is left,
    the targets turned by one, until nothing is left that could move. Running sums a server and
    joins on slots of room: no server's chunks are gathered in one place. The driver has a number
    for each under-used server.
    """
    mean = servers.agg(F.avg("util").alias("mean"))
    b = utilisation_bands(servers, band).join(servers.select("server", "used", "total", "util"), "server").crossJoin(F.broadcast(mean))
    b = materialise(b.where("band <> 'within'"), "bands")  # one row a server
    under = b.where("band = 'under'").orderBy("util", "server").select("server", F.floor(F.col("mean") * (1 + band) * F.col("total") - F.col("used")).cast("long").alias("room"))
    rooms = [(r["server"], r["room"]) for r in under.collect()]
    mine = replicas.join(sizes.where(F.col("size") >= least).select("chunk_id", "size"), "chunk_id").join(b.where("band = 'over'").select("server", "surplus"), "server")
    rows = (W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(W.partitionBy("server").orderBy("chunk_id").rowsBetween(*rows)), F.lit(0))
    left = materialise(mine.withColumn("_b", before).where("_b < surplus").select("chunk_id", F.col("server").alias("src"), "size"), "offers")
    hosts = materialise(replicas.join(left.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.col("server").alias("dst")), "hosts")
    moves = left.select("chunk_id", "src", F.col("src").alias("dst")).limit(0)
    while (free := [(s, r) for s, r in rooms if r > 0]) and not left.isEmpty():
        each = left.groupBy("src").agg(F.sum("size").alias("_all"))
        each = each.select("src", F.coalesce(F.sum("_all").over(W.orderBy("src").rowsBetween(*rows)), F.lit(0)).alias("_from"))  # a row a server
        inside = F.coalesce(F.sum("size").over(W.partitionBy("src").orderBy("chunk_id").rowsBetween(*rows)), F.lit(0))
        placed = left.join(each, "src").withColumn("pos", F.col("_from") + inside).drop("_from")
        got = _offers(placed, free).join(hosts, ["chunk_id", "dst"], "left_anti")
        got = got.withColumn("_k", F.row_number().over(W.partitionBy("chunk_id", "dst").orderBy("src"))).where("_k = 1")
        got = materialise(got.select("chunk_id", "src", "dst", "size"), "moves")
        moves, hosts = moves.unionByName(got.drop("size")), hosts.unionByName(got.select("chunk_id", "dst"))
        taken = {r["dst"]: r["t"] for r in got.groupBy("dst").agg(F.sum("size").alias("t")).collect()}
        rooms = [(s, r - taken.get(s, 0)) for s, r in rooms[1:] + rooms[:1]]
        able = left.sparkSession.createDataFrame([(s,) for s, r in rooms if r > 0], "dst long")
        full = hosts.join(able, "dst").groupBy("chunk_id").agg(F.count("*").alias("_n")).where(F.col("_n") == sum(r > 0 for _, r in rooms))
        left = materialise(left.join(got, ["chunk_id", "src"], "left_anti").join(full, "chunk_id", "left_anti"), "offers")
    return moves


def weighted_pick(drives: DataFrame, picks: DataFrame) -> DataFrame:
    """``picks(pick, at)`` with ``at`` in [0, 1): the drive ``(drive, free)`` under that share of all free space.

    The drive is the first whose running share exceeds ``at``; drives without free space are out.
    """
    w = W.orderBy("drive")  # drives of one server
    d = drives.where("free > 0").withColumn("_to", F.sum("free").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    d = d.agg(F.array_sort(F.collect_list(F.struct("_to", "drive"))).alias("_d"), F.sum("free").alias("_all"))
    hit = F.get(F.filter("_d", lambda x: x._to > F.col("at") * F.col("_all")), F.lit(0))
    return picks.crossJoin(F.broadcast(d)).select("pick", hit.drive.alias("drive"))


def leased_files(chunks: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """Files with a valid lease ``(chunk_id, expires)`` on any chunk."""
    valid = leases.where(F.col("expires") >= now).select("chunk_id")
    return chunks.join(valid, "chunk_id", "left_semi").select("fid").distinct()


def executable_moves(plan: DataFrame, chunks: DataFrame, replicas: DataFrame, servers: DataFrame) -> DataFrame:
    """Moves that still make sense: the chunk exists, is at src, not at dst, and dst has room."""
    p = plan.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    p = p.join(replicas.select("chunk_id", F.col("server").alias("src")), ["chunk_id", "src"], "left_semi")
    p = p.join(replicas.select("chunk_id", F.col("server").alias("dst")), ["chunk_id", "dst"], "left_anti")
    return p.join(servers.where(F.col("util") <= MAX_UTIL).select(F.col("server").alias("dst")), "dst", "left_semi").select("chunk_id", "src", "dst")


def throttled(moves: DataFrame, writes: int = 5, reads: int = 10) -> DataFrame:
    """At most ``writes`` moves to a target and ``reads`` from a source at a time."""
    m = moves.withColumn("w", F.row_number().over(W.partitionBy("dst").orderBy("chunk_id"))).where(F.col("w") <= writes)
    m = m.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("chunk_id"))).where(F.col("r") <= reads)
    return m.select("chunk_id", "src", "dst")


def rack_space(servers: DataFrame) -> DataFrame:
    s = servers.groupBy("rack").agg(F.sum("total").alias("total"), F.sum("used").alias("used"), F.count("*").alias("n_servers"))
    return s.withColumn("available", F.greatest(F.col("total") - F.col("used"), F.lit(0).cast("long")))


def system_totals(servers: DataFrame) -> DataFrame:
    return servers.agg(F.count("*").alias("n_servers"), F.sum("total").alias("total"), F.sum("used").alias("used"))


def ping_report(servers: DataFrame, replicas: DataFrame) -> DataFrame:
    n = replicas.groupBy("server").agg(F.count("*").alias("n_blocks"))
    s = servers.join(n, "server", "left")
    return s.select(
        "server", "rack", "used", (F.col("total") - F.col("used")).alias("free"), F.round("util", 6).alias("util"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), (F.col("util") > MAX_UTIL).alias("overloaded"),
    )


def retiring_progress(replicas: DataFrame, retiring: DataFrame, target: int = TARGET) -> DataFrame:
    """Chunks of each retiring server that have enough copies elsewhere, and those that have not."""
    r = replicas.join(retiring.select("server", F.lit(True).alias("_out")), "server", "left")
    elsewhere = r.groupBy("chunk_id").agg(F.count_if(F.col("_out").isNull()).alias("others"))
    mine = r.where("_out").join(elsewhere, "chunk_id")
    return mine.groupBy("server").agg(F.count_if(F.col("others") >= target).alias("done"), F.count_if(F.col("others") < target).alias("left"))


def without_corrupt(replicas: DataFrame, reports: DataFrame) -> DataFrame:
    """Copies left when those of ``reports(chunk_id, server)`` are dropped."""
    return not_in(replicas, reports, "chunk_id", "server")


def agreed_size(reports: DataFrame) -> DataFrame:
    """The size and checksum a chunk is sealed with: those of its smallest copy."""
    s = reports.groupBy("chunk_id").agg(F.min(F.struct("size", "checksum")).alias("s"))
    return s.select("chunk_id", "s.size", "s.checksum")


def replica_choice(replicas: DataFrame, local: DataFrame, slow: DataFrame) -> DataFrame:
    """The copy to read: a local one, else one not on a slow server unless all are, lowest number first."""
    r = replicas.join(local.select("chunk_id", "server", F.lit(0).alias("_l")), ["chunk_id", "server"], "left")
    r = r.join(slow.select("server", F.lit(1).alias("_s")), "server", "left")
    best = r.groupBy("chunk_id").agg(F.min(F.struct(F.coalesce("_l", F.lit(1)).alias("l"), F.coalesce("_s", F.lit(0)).alias("s"), "server")).alias("b"))
    return best.select("chunk_id", "b.server")
