"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import health, integrity, keyed, namespace, oplog
from tidemark.plans.inputs import CH, CL, CS, EV, IX, LEASE, LIM, ND, PL, PT, REC, RP, SV, SZ, with_
from tidemark.session import materialise, table
from tidemark.sources import sinks, text
from tidemark.sources import tables as t
from tidemark.streaming import batch, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its equivalent."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---------------------------------------------------------------- keyed records
def _twice(s, d):
    r = t.records(s, d)
    return r.unionByName(r.where(F.col("seq") % 3 == 0))


TWICE = "tw AS (SELECT * FROM rec UNION ALL SELECT * FROM rec WHERE seq % 3 = 0)"


@query(with_(REC) + "SELECT part, attempt, seq, key, qty, rec_len FROM rec")
def seq_stamp(s, d):
    return t.records(s, d).select("part", "attempt", "seq", "key", "qty", "rec_len")


@query(with_(REC) + "SELECT part, key, count(*) n, round(sum(qty), 2) sum_qty FROM rec GROUP BY 1, 2")
def keyed_group_sorted(s, d):
    once = keyed.drop_duplicate_records(_twice(s, d))
    return keyed.group_totals(once, "part", "key").sortWithinPartitions("part", "key")


@query(with_(REC, TWICE) + "SELECT part, attempt, count(DISTINCT seq) n, round(sum(DISTINCT CASE WHEN seq >= 0 THEN seq END), 2)::BIGINT sum_seq FROM tw GROUP BY 1, 2")
def keyed_dedup(s, d):
    return keyed.drop_duplicate_records(_twice(s, d)).groupBy("part", "attempt").agg(F.count("*").alias("n"), F.sum("seq").alias("sum_seq"))


@query(with_(REC) + "SELECT part, count(*) n, round(sum(qty), 2) sum_qty FROM rec WHERE NOT (retry = 0 AND mapper % 4 = 1) GROUP BY 1")
def dead_attempt_filter(s, d):
    r = t.records(s, d)
    dead = s.range(1, t.MAPPERS, 4).select(scalar.pack_attempt("id", F.lit(0)).alias("attempt"))
    return keyed.group_totals(keyed.drop_dead_attempts(r, dead), "part")


@query(with_(REC) + "SELECT mapper, retry, count(*) n, round(sum(qty), 2) sum_qty FROM rec r WHERE retry = (SELECT max(retry) FROM rec x WHERE x.mapper = r.mapper) GROUP BY 1, 2")
def attempt_latest(s, d):
    return keyed.group_totals(keyed.latest_attempt(t.records(s, d)), "mapper", "retry")


@query(with_(REC) + "SELECT key, count(*) n, round(sum(qty), 2) sum_qty FROM rec WHERE key >= '0000000100' AND key < '0000002000' GROUP BY 1")
def range_filter(s, d):
    return keyed.group_totals(keyed.key_range(t.records(s, d), "0000000100", "0000002000"), "key")


def _index(s, d):
    return keyed.sparse_index(t.records(s, d), 16)


def _sizes(s, d):
    return t.records(s, d).groupBy("part").agg(F.sum("rec_len").alias("bytes"))


def _plan(s, d):
    return keyed.range_plan(materialise(_index(s, d), "index"), _sizes(s, d), LIM)  # the index is a stored table


@query(with_(REC, IX) + 'SELECT part, attempt, rec_no, "offset", key, rec_len FROM ix')
def sparse_index(s, d):
    return _index(s, d)


@query(with_(REC, """o AS (SELECT *, row_number() OVER w k, count(*) OVER (PARTITION BY part, attempt) n, sum(rec_len) OVER w - rec_len off FROM rec WINDOW w AS (PARTITION BY part, attempt ORDER BY key, seq)),
  q AS (SELECT DISTINCT part, attempt, 0::BIGINT k, 4097::BIGINT held, false st FROM rec UNION ALL
    SELECT o.part, o.attempt, o.k, CASE WHEN held + rec_len > 4096 THEN rec_len ELSE held + rec_len END, held + rec_len > 4096 FROM q JOIN o ON o.part = q.part AND o.attempt = q.attempt AND o.k = q.k + 1)""", recursive=True)
  + 'SELECT part, attempt, k - 1 rec_no, off::BIGINT AS "offset", key, rec_len FROM q JOIN o USING (part, attempt, k) WHERE st OR k = n')
def sparse_index_overflow(s, d):
    return keyed.overflow_index(t.records(s, d), 4096)


@query(with_(REC, IX) + """SELECT part, attempt, coalesce(max(CASE WHEN key < '0000000500' THEN rec_no END), min(rec_no)) start_rec,
  coalesce(min(CASE WHEN key >= '0000001500' THEN rec_no END), max(rec_no)) end_rec,
  greatest(coalesce(min(CASE WHEN key >= '0000001500' THEN rec_no END), max(rec_no)) - coalesce(max(CASE WHEN key < '0000000500' THEN rec_no END), min(rec_no)) + 1, 0) estimate
  FROM ix GROUP BY 1, 2""")
def index_range_lookup(s, d):
    return keyed.index_range(_index(s, d), "0000000500", "0000001500")


@query(with_(REC, IX) + """SELECT part, sum(e)::BIGINT estimate FROM (SELECT part, greatest(coalesce(min(CASE WHEN key >= '0000001500' THEN rec_no END), max(rec_no))
  - coalesce(max(CASE WHEN key < '0000000500' THEN rec_no END), min(rec_no)) + 1, 0) e FROM ix GROUP BY part, attempt) GROUP BY 1""")
def record_estimate(s, d):
    return index_range_lookup(s, d).groupBy("part").agg(F.sum("estimate").alias("estimate"))


@query(with_(REC, IX, SZ, PL) + "SELECT part, task, low, high FROM pl")
def range_plan(s, d):
    return _plan(s, d)


@query(with_(REC, IX.replace("ix AS", "ix0 AS"), """ru AS (SELECT part, attempt, min(rec_no) lo, max(rec_no) hi, row_number() OVER (PARTITION BY part ORDER BY attempt) - 1 run FROM ix0 GROUP BY 1, 2),
  ix AS (SELECT ix0.* FROM ix0 JOIN ru USING (part, attempt) WHERE run < 6 OR run % 4 = 0 OR rec_no IN (lo, hi))""", SZ, PL) + "SELECT part, task, low, high FROM pl")
def range_plan_sampled(s, d):
    return keyed.range_plan(keyed.sampled_index(materialise(_index(s, d), "index"), 6, 4), _sizes(s, d), LIM)


@query(with_(REC, IX, SZ, PL) + "SELECT pl.part, task, count(*) n, round(sum(qty), 2) sum_qty FROM pl JOIN rec ON rec.part = pl.part AND hex(key) >= low AND hex(key) < high GROUP BY 1, 2")
def range_assign(s, d):
    return keyed.group_totals(keyed.assign_ranges(t.records(s, d), _plan(s, d)), "part", "task")


@query(with_(REC, SZ) + f"SELECT part, i::INT task, i * {LIM} low, least((i + 1) * {LIM}, bytes) high FROM (SELECT part, bytes, unnest(range(0, ceil(bytes / {LIM})::BIGINT)) i FROM sz)")
def chunk_split_plan(s, d):
    return keyed.byte_splits(_sizes(s, d), LIM)


#: Streams in order of arrival: every 101st record comes three places late.
@query(with_(REC) + """, a AS (SELECT part, attempt, key, seq * 2 + (CASE WHEN seq % 101 = 50 THEN 7 ELSE 0 END) pos FROM rec)
  SELECT count(*) n_records, count_if(prev > key)::BIGINT n_violations FROM (SELECT key, lag(key) OVER (PARTITION BY part, attempt ORDER BY pos) prev FROM a)""")
def merge_validate(s, d):
    late = F.when(F.col("seq") % 101 == 50, 7).otherwise(0)
    return keyed.order_violations(t.records(s, d), F.col("seq") * 2 + late, "part", "attempt")


@query(with_(REC) + "SELECT group_size, count(*) n_groups FROM (SELECT count(*) group_size FROM rec GROUP BY part, key) GROUP BY 1")
def group_histogram(s, d):
    return keyed.group_size_histogram(t.records(s, d))


@query(with_(REC) + "SELECT attempt, count(*) n_records, sum(rec_len)::BIGINT n_bytes FROM rec GROUP BY 1")
def task_stats(s, d):
    return keyed.task_statistics(t.records(s, d))


@query(with_(REC, TWICE) + "SELECT part, expected, actual, actual - expected difference FROM (SELECT part, count(*) expected FROM rec GROUP BY 1) JOIN (SELECT part, count(*) actual FROM tw GROUP BY 1) USING (part)")
def reconcile_counts(s, d):
    return keyed.reconcile(t.records(s, d).groupBy("part").agg(F.count("*").alias("expected")), _twice(s, d))


@query(with_(REC) + """, a AS (SELECT part, key, row_number() OVER (PARTITION BY part ORDER BY key) pos FROM rec), b AS (SELECT part, key, row_number() OVER (PARTITION BY part ORDER BY key) pos FROM rec WHERE seq <> 7)
  SELECT part, pos, a.key key_a, b.key key_b FROM a FULL JOIN b USING (part, pos) WHERE a.key IS DISTINCT FROM b.key""")
def key_compare(s, d):
    r = t.records(s, d)
    return keyed.compare_keys(r, r.where("seq <> 7"))


@query(with_(REC, IX, SZ, PL) + """, m AS (SELECT part, max(task) + 1 nw FROM pl GROUP BY 1), k AS (SELECT hex('0000000900') k)
  SELECT part, task, low, CASE WHEN part = 3 AND task = 0 AND k > low AND k < high THEN k ELSE high END high FROM pl, k
  UNION ALL SELECT part, nw, k, high FROM pl JOIN m USING (part), k WHERE part = 3 AND task = 0 AND k > low AND k < high""")
def preempt_remainder(s, d):
    return keyed.split_range_at(_plan(s, d), 3, 0, F.hex(F.lit("0000000900")))


def _appended(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), (F.col("l_partkey") % t.MAPPERS).alias("mapper"))


@query("SELECT l_orderkey chunk_id, array_to_string(list_sort(list(DISTINCT l_partkey % 16)), ',') mappers FROM lineitem GROUP BY 1")
def chunk_lineage(s, d):
    return keyed.chunk_lineage(_appended(s, d)).withColumn("mappers", F.array_join(F.col("mappers").cast("array<string>"), ","))


@query("SELECT DISTINCT l_partkey % 16 mapper FROM lineitem WHERE l_orderkey % 997 = 5")
def rerun_tasks(s, d):
    return keyed.mappers_to_rerun(_appended(s, d), table(s, d, "orders").where("o_orderkey % 997 = 5").select(F.col("o_orderkey").alias("chunk_id")))


@query(with_(REC, """o AS (SELECT *, row_number() OVER (PARTITION BY part, attempt ORDER BY seq) k FROM rec),
  q AS (SELECT DISTINCT part, attempt, 0::BIGINT k, 0::BIGINT off, 0::BIGINT fin FROM rec UNION ALL SELECT part, attempt, k, off, off + rec_len FROM (
    SELECT o.part, o.attempt, o.k, rec_len, CASE WHEN fin % 1024 + rec_len > 1024 THEN fin + 1024 - fin % 1024 ELSE fin END off FROM q JOIN o ON o.part = q.part AND o.attempt = q.attempt AND o.k = q.k + 1))""", recursive=True)
  + 'SELECT part, attempt, seq, rec_len, off AS "offset" FROM q JOIN o USING (part, attempt, k)')
def append_chunk_packing(s, d):
    return keyed.pack_into_chunks(t.records(s, d), 1024)


# ---------------------------------------------------------------- namespace
@query(with_(ND, PT, recursive=True) + "SELECT fid, path FROM pt")
def path_of(s, d):
    return namespace.paths(t.nodes(s, d), t.ROOT).select("fid", "path")


@query(with_(ND, PT, recursive=True) + "SELECT CASE type WHEN 'dir' THEN concat('path ', path, ' ', fid, ' ', mtime) ELSE concat(path, ' ', fid, ' ', size, ' ', mtime) END line FROM pt")
def list_paths(s, d):
    p = namespace.paths(t.nodes(s, d), t.ROOT)
    fid, size, mtime = (F.col(c).cast("string") for c in ("fid", "size", "mtime"))
    return p.select(F.when(F.col("type") == "dir", F.concat_ws(" ", F.lit("path"), "path", fid, mtime)).otherwise(F.concat_ws(" ", "path", fid, size, mtime)).alias("line"))


@query(with_(ND, PT, recursive=True) + "SELECT row_number() OVER (ORDER BY path) - 1 pos, path, fid FROM pt")
def list_paths_ordered(s, d):
    return namespace.ordered(namespace.paths(t.nodes(s, d), t.ROOT).select("path", "fid")).select("pos", "path", "fid")


@query(with_(ND, PT, recursive=True) + "SELECT path, fid, type, size, mtime FROM pt")
def path_lookup(s, d):
    r = table(s, d, "region").select(F.col("r_regionkey").alias("k1"), F.concat(F.lit("/"), "r_name").alias("p1"))
    n = table(s, d, "nation").join(r, F.col("n_regionkey") == F.col("k1")).select(F.col("n_nationkey").alias("k2"), F.concat("p1", F.lit("/"), "n_name").alias("p2"))
    c = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("k2")).select(F.col("c_custkey").alias("k3"), F.concat("p2", F.lit("/"), "c_name").alias("p3"))
    o = table(s, d, "orders").join(c, F.col("o_custkey") == F.col("k3")).select(F.concat("p3", F.lit("/o"), F.col("o_orderkey").cast("string")))
    return namespace.lookup_paths(t.nodes(s, d), r.select("p1").union(n.select("p2")).union(c.select("p3")).union(o).toDF("path"), t.ROOT)


@query(with_(ND) + "SELECT parent, name, fid, type, size, mtime FROM nd")
def name_lookup(s, d):
    n = t.nodes(s, d)
    return namespace.lookup(n, n.select("parent", "name").unionByName(n.select("parent", F.concat("name", F.lit("?")).alias("name"))))


def _every_directory(s, n):
    return n.where("type = 'dir'").select("fid").unionByName(s.range(t.ROOT, t.ROOT + 1).toDF("fid"))


@query(with_(ND) + "SELECT parent, name FROM nd")
def readdir(s, d):
    n = t.nodes(s, d)
    return namespace.readdir(n, _every_directory(s, n))


def _file_chunks(s, d):
    return t.chunks(s, d).withColumn("fid", F.col("chunk_id") + 4 * t.LEVEL)


@query(with_(ND, CH) + """, c AS (SELECT chunk_id + 4000000000 fid, count(*) chunk_count, max_by(chunk_id, "offset") last_chunk, max("offset") last_offset FROM ch GROUP BY 1)
  SELECT parent, name, nd.fid, type, size, mtime, coalesce(chunk_count, 0) chunk_count, last_chunk, last_offset FROM nd LEFT JOIN c ON c.fid = nd.fid""")
def readdirplus(s, d):
    n = t.nodes(s, d)
    return namespace.readdirplus(n, _every_directory(s, n), _file_chunks(s, d))


@query(with_(ND, CL, recursive=True) + """, pr AS (SELECT fid, 1000000000 + fid % 5 ancestor FROM nd WHERE type = 'dir' UNION ALL SELECT a.fid, b.parent FROM nd a JOIN nd b ON a.parent = b.fid WHERE a.type = 'dir')
  SELECT pr.fid, pr.ancestor, cl.fid IS NOT NULL descendant FROM pr LEFT JOIN cl ON cl.fid = pr.fid AND cl.ancestor = pr.ancestor AND depth > 0""")
def is_descendant(s, d):
    """Every directory against one region, and against the directory two levels up."""
    dirs = t.nodes(s, d).where("type = 'dir'").select("fid", "parent")
    two_up = dirs.join(dirs.select(F.col("fid").alias("parent"), F.col("parent").alias("ancestor")), "parent").select("fid", "ancestor")
    pairs = dirs.select("fid", (t.LEVEL + F.col("fid") % 5).alias("ancestor")).unionByName(two_up)
    return namespace.is_descendant(t.nodes(s, d), pairs, t.ROOT)


TOT = """f AS (SELECT parent fid, sum(greatest(size, 0)) b, count(*) n, max(CASE WHEN size > 0 THEN mtime END) t FROM nd WHERE type = 'file' GROUP BY 1),
  tot AS (SELECT ancestor fid, sum(coalesce(b, 0))::BIGINT bytes, sum(coalesce(n, 0))::BIGINT n_files, max(greatest(t, mtime)) mtime
    FROM (SELECT * FROM cl UNION ALL SELECT 2, 2, 0) c LEFT JOIN f USING (fid) LEFT JOIN (SELECT fid, mtime FROM nd) o USING (fid) GROUP BY 1)"""


@query(with_(ND, CL, TOT, recursive=True) + "SELECT fid, bytes FROM tot")
def dir_size(s, d):
    return namespace.directory_totals(t.nodes(s, d), t.ROOT).select("fid", "bytes")


@query(with_(ND, CL, TOT, recursive=True) + "SELECT fid, mtime FROM tot")
def dir_mtime(s, d):
    return namespace.directory_totals(t.nodes(s, d), t.ROOT).select("fid", "mtime")


@query(with_(ND, CL, TOT, recursive=True) + "SELECT fid, n_files, bytes FROM tot")
def dir_summary(s, d):
    return namespace.directory_totals(t.nodes(s, d), t.ROOT).select("fid", "n_files", "bytes")


@query(with_(ND, CL, TOT, recursive=True) + """, x AS (SELECT parent fid, sum(-size) dl FROM nd WHERE type = 'file' AND fid % 3 = 0 GROUP BY 1),
  u AS (SELECT ancestor fid, sum(dl) dl FROM cl JOIN x USING (fid) GROUP BY 1) SELECT fid, greatest(bytes + coalesce(dl, 0), 0)::BIGINT bytes FROM tot LEFT JOIN u USING (fid)""")
def dir_size_after_removal(s, d):
    n = t.nodes(s, d)
    gone = n.where("type = 'file' and fid % 3 = 0").select("parent", (-F.col("size")).alias("delta"))
    return namespace.apply_size_changes(namespace.directory_totals(n, t.ROOT), n, gone, t.ROOT)


@query(with_(CH, RP) + """SELECT fid, "offset", chunk_id, version, array_to_string(coalesce(l, []), ',') servers FROM ch LEFT JOIN (SELECT chunk_id, list_sort(list(server)) l FROM rp GROUP BY 1) USING (chunk_id)""")
def layout(s, d):
    return namespace.layout(t.chunks(s, d), t.replicas(s, d)).withColumn("servers", F.array_join(F.col("servers").cast("array<string>"), ","))


@query(with_(CH) + f""", w AS (SELECT c_custkey fid, c_custkey * 9973717 % {4 * CS} pos FROM customer) SELECT fid, pos, chunk_id, version FROM w JOIN ch USING (fid) WHERE "offset" = pos - pos % {CS}""")
def getalloc(s, d):
    wanted = table(s, d, "customer").select(F.col("c_custkey").alias("fid"), (F.col("c_custkey") * 9973717 % (4 * CS)).alias("pos"))
    return namespace.chunk_at(t.chunks(s, d), wanted, CS)


@query(with_(CH, RP) + f""", w AS (SELECT c_custkey fid, c_custkey * 9973717 % {4 * CS} start, {CS + 1} len FROM customer),
  l AS (SELECT chunk_id, array_to_string(list_sort(list(server)), ',') x FROM rp GROUP BY 1)
  SELECT fid, start, chunk_id, "offset", coalesce(x, '') servers FROM w JOIN ch USING (fid) LEFT JOIN l USING (chunk_id) WHERE "offset" < start + len AND "offset" + {CS} > start""")
def data_location(s, d):
    ranges = table(s, d, "customer").select(F.col("c_custkey").alias("fid"), (F.col("c_custkey") * 9973717 % (4 * CS)).alias("start"), F.lit(CS + 1).alias("len"))
    return namespace.data_location(t.chunks(s, d), t.replicas(s, d), ranges, CS).withColumn("servers", F.array_join(F.col("servers").cast("array<string>"), ","))


@query("""SELECT doc_id fid, i * 1024 AS "offset", i % 3 = 1 AS hole, least(1024, n - i * 1024) AS n FROM (SELECT doc_id, strlen(text) n, unnest(range(0, (strlen(text) + 1023) // 1024)) i FROM documents)""")
def read_with_holes(s, d):
    files = table(s, d, "documents").select(F.col("doc_id").alias("fid"), F.col("text").cast("binary").alias("data"))
    got = integrity.blocks(files, 1024).select("fid", (F.col("block").cast("long") * 1024).alias("offset"), "data").where("offset div 1024 % 3 <> 1")
    whole = namespace.read_blocks(got, files.select("fid", F.octet_length("data").cast("long").alias("size")), 1024)
    n = F.octet_length("data")
    return whole.select("fid", "offset", (F.hex("data") == F.repeat(F.lit("00"), n)).alias("hole"), n.cast("long").alias("n"))


@query(with_(ND) + "SELECT fid, name LIKE '%.tmp%' allowed FROM (SELECT fid, CASE WHEN fid % 3 = 0 THEN name || '.tmp1' ELSE name END AS name FROM nd)")
def worm_guard(s, d):
    name = F.when(F.col("fid") % 3 == 0, F.concat("name", F.lit(".tmp1"))).otherwise(F.col("name"))
    return t.nodes(s, d).select("fid", scalar.worm_allows(name).alias("allowed"))


@query(with_(ND) + "SELECT fid, name <> '' AND NOT contains(name, '/') legal FROM (SELECT fid, CASE fid % 4 WHEN 0 THEN '' WHEN 1 THEN 'a/' || name ELSE name END AS name FROM nd)")
def legal_name(s, d):
    name = F.when(F.col("fid") % 4 == 0, "").when(F.col("fid") % 4 == 1, F.concat(F.lit("a/"), "name")).otherwise(F.col("name"))
    return t.nodes(s, d).select("fid", scalar.legal_name(name).alias("legal"))


@query(with_(CH) + f""", c AS (SELECT o_custkey fid, min(o_custkey * 7919 * 8191 % {6 * CS}) cut FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1),
  j AS (SELECT *, cut IS NOT NULL AND cut % {CS} > 0 AND NOT coalesce(bool_or("offset" = cut - cut % {CS}) OVER (PARTITION BY fid), false) allocate FROM ch LEFT JOIN c USING (fid))
  SELECT fid, "offset", chunk_id, allocate FROM j WHERE cut IS NULL OR "offset" < cut""")
def truncate_chunks(s, d):
    c = t.chunks(s, d)
    cuts = c.where("fid % 2 = 0").select("fid").distinct().withColumn("size_cut", F.col("fid") * 7919 * 8191 % (6 * CS))
    return namespace.truncate(c, cuts, CS)


@query(with_(CH) + f""", j AS (SELECT *, CASE WHEN fid % 2 = 0 THEN fid * 7919 * 8191 % {6 * CS} END h FROM ch)
  SELECT fid, "offset", chunk_id, count(*) OVER (PARTITION BY fid) chunk_count FROM j WHERE h IS NULL OR "offset" >= h - h % {CS}""")
def prune_head(s, d):
    c = t.chunks(s, d)
    return namespace.prune_head(c, c.where("fid % 2 = 0").select("fid").distinct().withColumn("head", F.col("fid") * 7919 * 8191 % (6 * CS)), CS)


@query(with_(CH) + f""", e AS (SELECT fid, max("offset") + {CS} e FROM ch GROUP BY 1)
  SELECT CASE WHEN ch.fid % 10 = 1 THEN ch.fid + 1 ELSE ch.fid END fid, "offset" + CASE WHEN ch.fid % 10 = 1 THEN coalesce(e, 0) ELSE 0 END AS "offset", chunk_id, version FROM ch LEFT JOIN e ON e.fid = ch.fid + 1""")
def coalesce_blocks(s, d):
    c = t.chunks(s, d)
    return namespace.coalesce_blocks(c, c.where("fid % 10 = 1").select(F.col("fid").alias("src"), (F.col("fid") + 1).alias("dst")).distinct(), CS)


@query(with_(CH) + f""", w AS (SELECT fid, chunk_id AS id, CASE chunk_id % 3 WHEN 0 THEN -1 WHEN 1 THEN "offset" + {CS}::BIGINT * 1000 ELSE "offset" + (chunk_id % 2) * 17 END AS "offset", chunk_id + 10000000 AS nw FROM ch),
  e AS (SELECT fid, max("offset") + {CS} e FROM ch GROUP BY 1), v AS (SELECT fid, max("offset") + {CS} v FROM w WHERE "offset" >= 0 AND "offset" % {CS} = 0 GROUP BY 1),
  p AS (SELECT fid, id, nw, CASE WHEN "offset" = -1 THEN greatest(e, v) + (row_number() OVER (PARTITION BY fid, "offset" = -1 ORDER BY id) - 1) * {CS} ELSE "offset" END AS "offset" FROM w LEFT JOIN e USING (fid) LEFT JOIN v USING (fid))
  SELECT fid, id, "offset", CASE WHEN "offset" % {CS} = 0 THEN coalesce(chunk_id, nw) END chunk_id, CASE WHEN "offset" % {CS} = 0 THEN coalesce(version + 1, 1) END AS version,
  CASE WHEN "offset" % {CS} <> 0 THEN 'EINVAL' WHEN chunk_id IS NOT NULL THEN 'EEXIST' ELSE 'OK' END outcome FROM p LEFT JOIN ch USING (fid, "offset")""")
def allocate_chunks(s, d):
    c, k = t.chunks(s, d), F.col("chunk_id")
    at = F.when(k % 3 == 0, -1).when(k % 3 == 1, F.col("offset") + 1000 * CS).otherwise(F.col("offset") + k % 2 * 17)
    return namespace.allocate(c, c.select("fid", k.alias("id"), at.alias("offset"), (k + 10_000_000).alias("chunk_id")), CS)


@query(with_(ND, CL, recursive=True) + "SELECT DISTINCT nd.fid, 5 AS replication FROM nd JOIN cl ON cl.fid = nd.parent WHERE nd.type = 'file' AND cl.ancestor IN (1000000001, 2000000003)")
def set_replication_recursive(s, d):
    n = t.nodes(s, d)
    return namespace.set_replication(n, n.where("fid in (1000000001, 2000000003)"), F.lit(5), t.ROOT)


# ---------------------------------------------------------------- operation log
LOG = """lg AS (SELECT us, event_id, CASE event_type WHEN 'signup' THEN concat('create/dir/2/name/u', user_id, '/id/', user_id, '/numReplicas/3/ctime/', us)
  WHEN 'view' THEN concat('setmtime/file/', user_id, '/mtime/', us) WHEN 'click' THEN concat('size/file/', user_id, '/filesize/', round(value * 100)::BIGINT)
  WHEN 'purchase' THEN concat('setrep/file/', user_id, '/replicas/', event_id % 5 + 1) ELSE concat('remove/dir/2/name/u', user_id) END line FROM ev)"""


def _ops(s, d):
    return oplog.parse(t.log_lines(s, d)).withColumn("seqno", F.struct("us", "event_id"))


@query(with_(EV, LOG) + "SELECT event_id, string_split(line, '/')[1] op, CASE WHEN line LIKE 'create%' OR line LIKE 'remove%' THEN NULL ELSE string_split(line, '/')[3]::BIGINT END fid FROM lg")
def oplog_parse(s, d):
    return _ops(s, d).select("event_id", "op", oplog.arg("file").alias("fid"))


@query(with_(EV) + """SELECT user_id fid, max_by(round(value * 100)::BIGINT, (us, event_id)) FILTER (event_type = 'click') filesize,
  max_by(us, (us, event_id)) FILTER (event_type = 'view') mtime, max_by(event_id % 5 + 1, (us, event_id)) FILTER (event_type = 'purchase') replicas
  FROM ev WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1""")
def oplog_replay_lww(s, d):
    return oplog.replay_last_writer(_ops(s, d))


#: A file is what its last create made, unless a remove came later, and what came after that create.
@query(with_(EV) + """, c AS (SELECT user_id, max((us, event_id)) o, max(us) t FROM ev WHERE event_type = 'signup' GROUP BY 1),
  alive AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = c.user_id AND event_type = 'error' AND (us, event_id) > o)),
  e AS (SELECT ev.*, alive.t FROM alive JOIN ev ON ev.user_id = alive.user_id AND (us, event_id) >= o)
  SELECT user_id fid, 'u' || user_id AS name, coalesce(max_by(event_id % 5 + 1, (us, event_id)) FILTER (event_type = 'purchase'), 3) replicas, max(t) ctime,
  coalesce(max(us) FILTER (event_type = 'view'), max(t)) mtime, max_by(round(value * 100)::BIGINT, (us, event_id)) FILTER (event_type = 'click') filesize FROM e GROUP BY 1""")
def oplog_replay_full(s, d):
    ops = oplog.parse(t.log_lines(s, d)).withColumn("tree", F.coalesce(oplog.arg("file"), F.regexp_extract("line", "name/u([0-9]+)", 1).try_cast("long")))
    # no two events share a time and an id; the pair as one sortable number within a subtree
    ops = ops.withColumn("seqno", F.concat(F.lpad(F.col("us").cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 12, "0")))
    return oplog.replay(ops)


#: Names a and b in each user's directory; no event needs the outcome of another to be written.
NAMES = """no AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) k, event_id % 2 x, event_id % 3 = 0 excl,
  CASE event_type WHEN 'purchase' THEN 'rename' WHEN 'error' THEN CASE WHEN event_id % 4 < 2 THEN 'remove' ELSE 'rmdir' END ELSE CASE WHEN event_id % 5 = 0 THEN 'mkdir' ELSE 'create' END END op FROM ev),
  q AS (SELECT user_id, 0::BIGINT k, 0::BIGINT event_id, 0 t0, 0::BIGINT i0, 0 t1, 0::BIGINT i1, NULL::VARCHAR error FROM (SELECT DISTINCT user_id FROM ev) UNION ALL
    SELECT user_id, k, event_id, CASE WHEN x = 0 THEN nt ELSE nu END, CASE WHEN x = 0 THEN ni ELSE nj END, CASE WHEN x = 1 THEN nt ELSE nu END, CASE WHEN x = 1 THEN ni ELSE nj END, error FROM (
    SELECT *, CASE WHEN error IS NOT NULL THEN t WHEN op = 'create' THEN 1 WHEN op = 'mkdir' THEN 2 ELSE 0 END nt, CASE WHEN error IS NOT NULL THEN i WHEN op IN ('create', 'mkdir') THEN event_id ELSE 0 END ni,
      CASE WHEN error IS NULL AND op = 'rename' THEN t ELSE u END nu, CASE WHEN error IS NULL AND op = 'rename' THEN i ELSE j END nj FROM (
    SELECT *, CASE WHEN op = 'create' THEN CASE WHEN t = 2 THEN 'EISDIR' WHEN t = 1 AND excl THEN 'EEXIST' END WHEN op = 'mkdir' THEN CASE WHEN t > 0 THEN 'EEXIST' END WHEN t = 0 THEN 'ENOENT'
      WHEN op = 'remove' THEN CASE WHEN t = 2 THEN 'EISDIR' END WHEN op = 'rmdir' THEN CASE WHEN t = 1 THEN 'ENOTDIR' END WHEN u > 0 AND u <> t THEN CASE WHEN t = 2 THEN 'ENOTDIR' ELSE 'EISDIR' END END error FROM (
    SELECT no.user_id, no.k, no.event_id, no.x, no.excl, no.op, CASE WHEN x = 0 THEN t0 ELSE t1 END t, CASE WHEN x = 0 THEN i0 ELSE i1 END i, CASE WHEN x = 0 THEN t1 ELSE t0 END u, CASE WHEN x = 0 THEN i1 ELSE i0 END j
    FROM q JOIN no ON no.user_id = q.user_id AND no.k = q.k + 1))))"""


def _name_ops(s, d):
    """Logged operations on names, in order of a sortable ``seqno``."""
    e = t.events(s, d)
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    name, other = (F.when(k % 2 == i, "a").otherwise("b") for i in (0, 1))
    made = F.concat_ws("/", F.when(k % 5 == 0, "mkdir").otherwise("create"), F.lit("dir"), user, F.lit("name"), name, F.lit("id"), k.cast("string"), F.lit("exclusive"), (k % 3 == 0).cast("int").cast("string"))
    gone = F.concat_ws("/", F.when(k % 4 < 2, "remove").otherwise("rmdir"), F.lit("dir"), user, F.lit("name"), name)
    moved = F.concat_ws("/", F.lit("rename/dir"), user, F.lit("old"), name, F.lit("new"), other)
    line = F.when(F.col("event_type") == "purchase", moved).when(F.col("event_type") == "error", gone).otherwise(made)
    seqno = F.concat(F.lpad(F.col("us").cast("string"), 20, "0"), F.lpad(k.cast("string"), 12, "0"))
    return oplog.parse(e.select("user_id", "event_id", seqno.alias("seqno"), line.alias("line"))).withColumn("tree", oplog.arg("dir"))


@query(with_(EV, NAMES, recursive=True) + "SELECT event_id, coalesce(error, 'OK') outcome FROM q WHERE k > 0")
def namespace_errors(s, d):
    done = oplog.replay_names(_name_ops(s, d)).where("seqno is not null")
    return done.select(F.substring("seqno", 21, 12).cast("long").alias("event_id"), F.coalesce("error", F.lit("OK")).alias("outcome"))


@query(with_(EV, NAMES, """la AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)""", recursive=True) + """SELECT user_id parent, 'a' AS name, CASE t0 WHEN 1 THEN 'file' ELSE 'dir' END AS type, i0 fid FROM la WHERE t0 > 0
  UNION ALL SELECT user_id, 'b', CASE t1 WHEN 1 THEN 'file' ELSE 'dir' END, i1 FROM la WHERE t1 > 0""")
def oplog_replay_namespace(s, d):
    return oplog.replay_names(_name_ops(s, d)).where("seqno is null").select("parent", "name", "type", "fid")


def _chunk_ops(s, d):
    """Logged operations on the chunks of each user's file."""
    k, user = F.col("event_id"), F.col("user_id")
    s_ = lambda x: x.cast("string")
    chunk = s_(user * 1000 + k % 6)
    line = (
        F.when(F.col("event_type") == "view", F.concat_ws("/", F.lit("allocate/file"), s_(user), F.lit("offset"), s_(k % 6 * CS), F.lit("chunkId"), chunk, F.lit("chunkVersion"), s_(k % 9 + 1)))
        .when(F.col("event_type") == "click", F.concat_ws("/", F.lit("truncate/file"), s_(user), F.lit("offset"), s_(F.expr(f"event_id % 13 * {CS} div 2"))))
        .when(F.col("event_type") == "purchase", F.concat_ws("/", F.lit("pruneFromHead/file"), s_(user), F.lit("offset"), s_(F.expr(f"event_id % 5 * {CS} div 3"))))
        .when(F.col("event_type") == "error", F.concat_ws("/", F.lit("chunkVersionInc/file"), s_(user), F.lit("chunkId"), chunk, F.lit("chunkVersion"), s_(k % 9 + 20)))
        .otherwise(F.concat_ws("/", F.when(k % 2 == 0, "mkstable").otherwise("mkstabledone"), F.lit("fileId"), s_(user), F.lit("chunkId"), chunk, F.lit("chunkVersion"), s_(k % 9 + 1), F.lit("size"), s_(k % 1000)))
    )
    return oplog.parse(t.events(s, d).select("us", "event_id", line.alias("line"))).withColumn("seqno", F.struct("us", "event_id"))


@query(with_(EV) + f"""SELECT fid, o AS "offset", fid * 1000 + o // {CS} chunk_id, coalesce((SELECT max_by(event_id % 9 + 20, (us, event_id)) FROM ev v WHERE event_type = 'error' AND v.user_id = fid AND event_id % 6 = o // {CS} AND (us, event_id) > made), vs) AS version
  FROM (SELECT user_id fid, event_id % 6 * {CS} o, max((us, event_id)) made, max_by(event_id % 9 + 1, (us, event_id)) vs FROM ev WHERE event_type = 'view' GROUP BY 1, 2) a
  WHERE NOT EXISTS (SELECT 1 FROM ev c WHERE c.user_id = fid AND (us, event_id) > made AND ((event_type = 'click' AND event_id % 13 * {CS} // 2 <= o) OR (event_type = 'purchase' AND event_id % 5 * {CS} // 3 // {CS} * {CS} > o)))""")
def oplog_replay_chunks(s, d):
    return oplog.replay_chunks(_chunk_ops(s, d), CS)


@query(with_(EV) + """SELECT user_id * 1000 + event_id % 6 chunk_id, event_id % 9 + 1 AS version, event_id % 1000 size FROM ev WHERE event_type = 'signup'
  QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 6 ORDER BY us DESC, event_id DESC) = 1 AND event_id % 2 = 0""")
def oplog_pending_stable(s, d):
    return oplog.pending_stable(_chunk_ops(s, d))


@query(with_(ND, CH) + "SELECT nd.fid, name, parent, type, 3::BIGINT replicas, mtime, size, coalesce(n, 0) chunk_count FROM nd LEFT JOIN (SELECT chunk_id + 4000000000 fid, count(*) n FROM ch GROUP BY 1) c ON c.fid = nd.fid")
def checkpoint_restore(s, d):
    return oplog.restore(oplog.checkpoint_lines(t.nodes(s, d), _file_chunks(s, d)), 2)


# ---------------------------------------------------------------- health
CNT = "cn AS (SELECT ch.chunk_id, fid, count(server) n FROM ch LEFT JOIN rp USING (chunk_id) GROUP BY 1, 2)"


def _cr(s, d):
    return t.chunks(s, d), t.replicas(s, d)


@query(with_(CH, RP, CNT) + "SELECT count(*) n_chunks, count_if(n = 0)::BIGINT lost, count_if(n = 1)::BIGINT endangered FROM cn")
def fsck_counts(s, d):
    return health.fsck_counts(*_cr(s, d))


@query(with_(CH, RP, CNT) + "SELECT fid, chunk_id, CASE n WHEN 0 THEN 'lost' ELSE 'endangered' END state FROM cn WHERE n < 2")
def fsck_files(s, d):
    return health.fsck_files(*_cr(s, d))


@query(with_(CH, RP, SV) + """, r AS (SELECT chunk_id, rack, lag(rack) OVER (PARTITION BY chunk_id ORDER BY server) prev FROM rp JOIN sv USING (server)),
  c AS (SELECT ch.chunk_id, count(rack) n, count(DISTINCT rack) racks, count_if(rack = prev) pairs FROM ch LEFT JOIN r USING (chunk_id) GROUP BY 1)
  SELECT count_if(n = 0)::BIGINT missing, count_if(n BETWEEN 1 AND 2)::BIGINT under, count_if(n > 3)::BIGINT AS over, count_if(n = 3 AND racks = 1)::BIGINT one_rack,
  sum(CASE WHEN n = 3 AND racks = 1 THEN 0 ELSE pairs END)::BIGINT same_rack_pairs, CASE WHEN count_if(n = 0) > 0 THEN 'CORRUPT' ELSE 'HEALTHY' END status FROM c""")
def fast_fsck(s, d):
    return health.fast_fsck(*_cr(s, d), t.servers(s, d))


@query(with_(SV) + """, h AS (SELECT l_orderkey chunk_id, l_suppkey server, CASE WHEN l_linenumber % 7 = 0 THEN 0 ELSE l_orderkey % 100 + (l_linenumber % 5 = 0)::INT END size FROM lineitem),
  g AS (SELECT chunk_id, count(*) n, count(DISTINCT server) ns, count(DISTINCT rack) nr, min(size) lo, max(size) hi, count_if(size = 0) z FROM h JOIN sv USING (server) GROUP BY 1)
  SELECT o_orderkey chunk_id, coalesce(nr < least(ns, 3) AND n > 0, false) same_rack, coalesce(n, 0) < 3 under, coalesce(ns < n, false) same_server, coalesce(lo <> hi, false) sizes_differ,
  coalesce(z, 0) > 0 zero_size, coalesce(n, 0) = coalesce(z, 0) missing FROM orders LEFT JOIN g ON chunk_id = o_orderkey""")
def replica_check(s, d):
    size = F.when(F.col("l_linenumber") % 7 == 0, 0).otherwise(F.col("l_orderkey") % 100 + (F.col("l_linenumber") % 5 == 0).cast("int"))
    hosted = table(s, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("server"), size.alias("size"))
    return health.replica_check(t.chunks(s, d), hosted, t.servers(s, d))


@query(with_(CH, RP) + """, st AS (SELECT ch.chunk_id, count(server) have, count_if(server % 20 = 0) retiring, ch.chunk_id % 11 = 0 leased, ch.chunk_id % 22 = 0 valid, ch.chunk_id % 13 <> 0 stable, fid % 17 <> 0 in_file
    FROM ch LEFT JOIN rp USING (chunk_id) GROUP BY ALL),
  x AS (SELECT *, CASE WHEN retiring = 0 OR have <= 3 + retiring THEN 3 + retiring - have ELSE 0 END e FROM st)
  SELECT chunk_id, (CASE WHEN have = 0 OR NOT in_file THEN 0 ELSE e END)::BIGINT extra, CASE WHEN have = 0 OR NOT in_file THEN 'drop' WHEN leased OR NOT stable OR (e < 0 AND valid) THEN 'wait'
    WHEN e > 0 THEN 'replicate' WHEN e < 0 THEN 'delete' ELSE 'none' END AS action FROM x""")
def replication_need(s, d):
    r = t.replicas(s, d).groupBy("chunk_id").agg(F.count("*").alias("have"), F.count_if(F.col("server") % 20 == 0).alias("retiring"))
    c = t.chunks(s, d).join(r, "chunk_id", "left").fillna(0, ["have", "retiring"])
    k = F.col("chunk_id")
    return health.replication_need(c.withColumns({"target": F.lit(3), "leased": k % 11 == 0, "valid_lease": k % 22 == 0, "stable": k % 13 != 0, "in_file": F.col("fid") % 17 != 0}))


@query(with_(CH, RP, CNT) + "SELECT chunk_id, n, CASE n WHEN 1 THEN 0 ELSE 1 END AS class FROM cn WHERE n BETWEEN 1 AND 2")
def priority_candidates(s, d):
    return health.prioritised(*_cr(s, d))


@query(with_(RP, SV) + """, r AS (SELECT chunk_id, server, rack, util, count(*) OVER (PARTITION BY chunk_id) n, row_number() OVER (PARTITION BY chunk_id, rack ORDER BY util, server) ir FROM rp JOIN sv USING (server)),
  q AS (SELECT *, count_if(ir = 1) OVER (PARTITION BY chunk_id) nr FROM r WHERE n > 3 AND chunk_id NOT IN (SELECT chunk_id FROM rp WHERE server % 50 = 9))
  SELECT chunk_id, server FROM q QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY nr = 3 AND ir > 1, util, server) > 3""")
def excess_delete(s, d):
    return health.excess(t.replicas(s, d), t.servers(s, d), retiring=_some(s, d, 50, 9))


@query(with_(CH) + """, r AS (SELECT l_suppkey server, l_orderkey + (l_linenumber = 7)::INT * 1000000000 chunk_id, l_orderkey k, o_custkey + (l_partkey % 50 = 0)::INT fid, l_orderkey % 5 + 1 + l_partkey % 3 - 1 AS version
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT server, r.chunk_id, CASE WHEN ch.chunk_id IS NULL THEN 'no mapping' WHEN ch.fid <> r.fid THEN 'not in file' WHEN ch.version > r.version THEN 'old version' ELSE 'reset' END reason
  FROM r LEFT JOIN ch ON ch.chunk_id = r.chunk_id WHERE ch.chunk_id IS NULL OR ch.fid <> r.fid OR ch.version <> r.version""")
def stale_replicas(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    reported = j.select(
        F.col("l_suppkey").alias("server"), (F.col("l_orderkey") + (F.col("l_linenumber") == 7).cast("long") * 10**9).alias("chunk_id"),
        (F.col("o_custkey") + (F.col("l_partkey") % 50 == 0).cast("long")).alias("fid"), (F.col("l_orderkey") % 5 + F.col("l_partkey") % 3).alias("version"))
    return health.stale_replicas(reported, t.chunks(s, d))


def _some(s, d, n, k):
    return t.servers(s, d).where(F.col("server") % n == k)


@query(with_(RP) + "SELECT server, chunk_id FROM rp WHERE server % 20 = 3")
def evacuate(s, d):
    return health.hosted_by(t.replicas(s, d), _some(s, d, 20, 3))


@query(with_(SV) + "SELECT server, rack FROM sv WHERE server % 4 = 0 AND NOT server % 3 = 0")
def down_not_up(s, d):
    return health.not_in(_some(s, d, 4, 0).select("server", "rack"), _some(s, d, 3, 0), "server")


@query(with_(SV) + "SELECT server, rack FROM sv WHERE server % 4 = 0 AND server % 3 = 0")
def retiring_up(s, d):
    return health.also_in(_some(s, d, 4, 0).select("server", "rack"), _some(s, d, 3, 0), "server")


@query(with_(SV) + """, x AS (SELECT server, 100000 - server * 37 % 900 h, CASE WHEN server % 5 = 0 THEN 100000 + server * 11 - 500 END u FROM sv)
  SELECT server, (CASE WHEN u > 100000 THEN u WHEN 600 - (100000 - h) > 15 THEN h + 600 ELSE 100000 END)::BIGINT start_at FROM x""")
def hibernation(s, d):
    sv = t.servers(s, d).select("server")
    down = sv.withColumn("last_heard", 100000 - F.col("server") * 37 % 900)
    return health.delayed_until(down, sv.where("server % 5 = 0").withColumn("until", 100000 + F.col("server") * 11 - 500), 100000).withColumn("start_at", F.col("start_at").cast("long"))


@query(with_(SV) + "SELECT server, rack, round(util, 6) util, total - used free FROM sv WHERE total - used >= 128 AND util <= 0.9 AND server % 7 <> 0 AND server % 11 <> 0 AND server % 13 <> 0")
def candidate_servers(s, d):
    n = F.col("server")
    flagged = t.servers(s, d).withColumns({"responsive": n % 7 != 0, "retiring": n % 11 == 0, "restarting": n % 13 == 0})
    return health.candidate_servers(flagged, 128).withColumn("util", F.round("util", 6))


@query(with_(SV) + """, c AS (SELECT * FROM sv WHERE total - used >= 1 AND util <= 0.9), tr AS (SELECT rack FROM c GROUP BY rack ORDER BY count(*) DESC, rack LIMIT 2),
  r AS (SELECT rack, server, row_number() OVER (PARTITION BY rack ORDER BY util, server) r FROM c SEMI JOIN tr USING (rack)) SELECT rack, server FROM r WHERE r <= 2 ORDER BY r, rack DESC LIMIT 3""")
def placement_det(s, d):
    return health.placement(t.servers(s, d), 3, 2)


@query(with_(CH, RP, SV, CNT) + """, nd AS (SELECT chunk_id FROM cn WHERE n BETWEEN 1 AND 2), o AS (SELECT * FROM sv WHERE total - used >= 1 AND util <= 0.9 QUALIFY row_number() OVER (PARTITION BY rack ORDER BY util, server) <= 4),
  h AS (SELECT chunk_id, server, rack FROM rp JOIN sv USING (server)),
  x AS (SELECT nd.chunk_id, o.server, o.util, (o.rack NOT IN (SELECT rack FROM h WHERE h.chunk_id = nd.chunk_id)) a, (o.server NOT IN (SELECT server FROM h WHERE h.chunk_id = nd.chunk_id)) b FROM nd, o)
  SELECT chunk_id, arg_min(server, (NOT a, util, server)) server FROM x WHERE b GROUP BY 1""")
def rereplicate_target(s, d):
    return health.rereplication_targets(*_cr(s, d), t.servers(s, d))


@query(with_(SV) + """SELECT server, rack, CASE WHEN util > m * 1.1 THEN 'over' WHEN util < m * 0.9 THEN 'under' ELSE 'within' END band, round((util - m) * total)::BIGINT surplus FROM sv, (SELECT avg(util) m FROM sv)""")
def util_bands(s, d):
    return health.utilisation_bands(t.servers(s, d))


@query(with_(SV) + "SELECT rack, sum(greatest(s, 0))::BIGINT to_move, sum(greatest(-s, 0))::BIGINT room FROM (SELECT rack, round((util - m) * total)::BIGINT s FROM sv, (SELECT avg(util) m FROM sv)) GROUP BY 1")
def rebalance_targets(s, d):
    z = F.lit(0).cast("long")
    b = health.utilisation_bands(t.servers(s, d))
    return b.groupBy("rack").agg(F.sum(F.greatest("surplus", z)).alias("to_move"), F.sum(F.greatest(-F.col("surplus"), z)).alias("room"))


def _moves(s, d):
    sizes = t.chunks(s, d).select("chunk_id", (F.col("chunk_id") % 50 + 1).alias("size"))
    return health.rebalance_plan(t.replicas(s, d), sizes, t.servers(s, d), least=5)


def _rebalanced(rounds: int) -> str:
    """The rounds of a plan one after the other; those after the last that moves anything are empty."""
    out = [RP, SV, """mu AS (SELECT avg(util) m FROM sv), ov AS (SELECT server, round((util - m) * total)::BIGINT surplus FROM sv, mu WHERE util > m * 1.1),
  u0 AS (SELECT server, row_number() OVER (ORDER BY util, server) - 1 turn, floor(m * 1.1 * total - used)::BIGINT room FROM sv, mu WHERE util < m * 0.9), un AS (SELECT count(*) n FROM u0),
  l0 AS (SELECT chunk_id, server src, size FROM (SELECT chunk_id, server, chunk_id % 50 + 1 size, surplus, coalesce(sum(chunk_id % 50 + 1) OVER (PARTITION BY server ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b
    FROM rp JOIN ov USING (server) JOIN (SELECT o_orderkey chunk_id FROM orders) USING (chunk_id) WHERE chunk_id % 50 + 1 >= 5) WHERE b < surplus),
  h0 AS (SELECT chunk_id, server dst FROM rp)"""]
    for i in range(rounds):
        out.append(f"""t{i} AS (SELECT server dst, coalesce(sum(room) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) lo, sum(room) OVER (ORDER BY turn) hi FROM u{i} WHERE room > 0),
  p{i} AS (SELECT *, coalesce(sum(size) OVER (ORDER BY src, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) pos FROM l{i}),
  g{i} AS (SELECT chunk_id, src, dst, size FROM p{i} JOIN t{i} ON lo <= pos AND pos < hi ANTI JOIN h{i} USING (chunk_id, dst) QUALIFY row_number() OVER (PARTITION BY chunk_id, dst ORDER BY src) = 1),
  h{i + 1} AS (SELECT * FROM h{i} UNION ALL SELECT chunk_id, dst FROM g{i}),
  u{i + 1} AS (SELECT server, (turn - 1 + n) % n turn, room - coalesce(x, 0) room FROM u{i} LEFT JOIN (SELECT dst, sum(size)::BIGINT x FROM g{i} GROUP BY 1) ON dst = server, un),
  f{i} AS (SELECT chunk_id FROM h{i + 1} JOIN u{i + 1} ON server = dst WHERE room > 0 GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM u{i + 1} WHERE room > 0)),
  l{i + 1} AS (SELECT * FROM l{i} ANTI JOIN g{i} USING (chunk_id, src) ANTI JOIN f{i} USING (chunk_id))""")
    return with_(*out, "mv AS (" + " UNION ALL ".join(f"SELECT chunk_id, src, dst FROM g{i}" for i in range(rounds)) + ")")


@query(_rebalanced(16) + "SELECT chunk_id, src, dst FROM mv")
def rebalance_plan(s, d):
    return _moves(s, d)


@query(_rebalanced(16) + """, w AS (SELECT mv.* FROM mv JOIN sv ON server = dst AND util <= 0.9 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY chunk_id) <= 5)
  SELECT chunk_id, src, dst FROM w QUALIFY row_number() OVER (PARTITION BY src ORDER BY chunk_id) <= 10""")
def rebalance_execute(s, d):
    return health.throttled(health.executable_moves(materialise(_moves(s, d), "moves"), *_cr(s, d), t.servers(s, d)))


@query(with_(SV) + "SELECT rack, sum(total)::BIGINT total, sum(used)::BIGINT used, count(*) n_servers, greatest(sum(total) - sum(used), 0)::BIGINT available FROM sv GROUP BY 1")
def rack_space(s, d):
    return health.rack_space(t.servers(s, d))


@query(with_(SV) + "SELECT count(*) n_servers, sum(total)::BIGINT total, sum(used)::BIGINT used FROM sv")
def system_totals(s, d):
    return health.system_totals(t.servers(s, d))


@query(with_(SV, RP) + "SELECT server, rack, used, total - used free, round(util, 6) util, coalesce(n, 0) n_blocks, util > 0.9 overloaded FROM sv LEFT JOIN (SELECT server, count(*) n FROM rp GROUP BY 1) USING (server)")
def ping_report(s, d):
    return health.ping_report(t.servers(s, d), t.replicas(s, d))


@query(with_(RP) + """, o AS (SELECT chunk_id, count_if(server % 10 <> 1) n FROM rp GROUP BY 1) SELECT server, count_if(n >= 3)::BIGINT done, count_if(n < 3)::BIGINT AS "left" FROM rp JOIN o USING (chunk_id) WHERE server % 10 = 1 GROUP BY 1""")
def retiring_progress(s, d):
    return health.retiring_progress(t.replicas(s, d), _some(s, d, 10, 1))


@query(with_(RP) + "SELECT server, count(*) n_left FROM rp WHERE (chunk_id + server) % 29 <> 0 GROUP BY 1")
def corrupt_report(s, d):
    r = t.replicas(s, d)
    return health.without_corrupt(r, r.where("(chunk_id + server) % 29 = 0")).groupBy("server").agg(F.count("*").alias("n_left"))


@query("SELECT l_orderkey chunk_id, min(l_partkey) size, arg_min(l_suppkey, (l_partkey, l_suppkey)) checksum FROM lineitem GROUP BY 1")
def make_stable(s, d):
    return health.agreed_size(table(s, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("size"), F.col("l_suppkey").alias("checksum")))


@query(with_(RP) + "SELECT chunk_id, arg_min(server, (NOT (chunk_id + server) % 7 = 0, server % 3 = 0, server)) server FROM rp GROUP BY 1")
def replica_choice(s, d):
    r = t.replicas(s, d)
    return health.replica_choice(r, r.where("(chunk_id + server) % 7 = 0"), _some(s, d, 3, 0))


@query(with_(SV) + """, d AS (SELECT server, total - used f FROM sv WHERE rack % 5 = 1 AND total > used), c AS (SELECT server, sum(f) OVER (ORDER BY server) t, sum(f) OVER () a FROM d)
  SELECT p pick, min(server) drive FROM (SELECT unnest(range(0, 1000)) p), c WHERE t > p / 1000 * a GROUP BY 1""")
def weighted_drive_pick(s, d):
    drives = t.servers(s, d).where("rack % 5 = 1").select(F.col("server").alias("drive"), (F.col("total") - F.col("used")).alias("free"))
    return health.weighted_pick(drives, s.range(1000).select(F.col("id").alias("pick"), (F.col("id") / 1000).alias("at")))


@query(with_(CH) + "SELECT DISTINCT fid FROM ch WHERE chunk_id % 9 = 0 AND chunk_id * 31 % 600 >= 300")
def leased_files(s, d):
    c = t.chunks(s, d)
    return health.leased_files(c, c.where("chunk_id % 9 = 0").select("chunk_id", (F.col("chunk_id") * 31 % 600).alias("expires")), 300)


@query("SELECT s_suppkey server, s_suppkey % 256 % 2 = 1 master FROM supplier")
def master_by_parity(s, d):
    ip = F.concat_ws(".", F.lit("10.0.0"), (F.col("s_suppkey") % 256).cast("string"))
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("server"), scalar.master_by_parity(ip).alias("master"))


# ---------------------------------------------------------------- integrity and scalars
def _files(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("fid"), F.col("text").cast("binary").alias("data"))


BLK = """fl AS (SELECT doc_id fid, encode(text) dt FROM documents), bl AS (SELECT fid, i::INT AS block, dt[i * 4096 + 1:(i + 1) * 4096] b FROM (SELECT fid, dt, unnest(range(0, (octet_length(dt) + 4095) // 4096)) i FROM fl)),
  by_ AS (SELECT fid, block, n, k, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT x FROM (SELECT fid, block, hex(b) h, octet_length(b) n, unnest(range(0, octet_length(b))) k FROM bl)),
  ad AS (SELECT fid, block, ((n + sum(x * (n - k)))::BIGINT % 65521) * 65536 + (1 + sum(x))::BIGINT % 65521 adler FROM by_ GROUP BY fid, block, n)"""


@query(with_(BLK) + "SELECT fid, block, adler FROM ad")
def adler32(s, d):
    return integrity.checksums(integrity.blocks(_files(s, d)))


@query("SELECT doc_id fid, md5(text) md5 FROM documents")
def md5_file(s, d):
    return integrity.file_md5(_files(s, d))


def _damaged(s, d):
    """Stored checksums: those of the blocks, but of every eleventh block one off."""
    c = integrity.checksums(integrity.blocks(_files(s, d)))
    return c.withColumn("adler", F.col("adler") + ((F.col("fid") + F.col("block")) % 11 == 0).cast("long"))


@query(with_(BLK) + """, bad AS (SELECT fid, min(block) b FROM ad WHERE (fid + block) % 11 = 0 GROUP BY 1)
  SELECT fl.fid, CASE WHEN fl.fid % 13 = 0 THEN 'EBADVERS' WHEN b IS NOT NULL THEN 'EBADCKSUM' ELSE 'OK' END status, CASE WHEN fl.fid % 13 <> 0 THEN b END AS block FROM fl LEFT JOIN bad ON bad.fid = fl.fid""")
def first_bad_block(s, d):
    versions = _files(s, d).select("fid", F.lit(1).alias("wanted"), F.when(F.col("fid") % 13 == 0, 2).otherwise(1).alias("has"))
    return integrity.first_bad_block(_damaged(s, d), integrity.checksums(integrity.blocks(_files(s, d))), versions)


@query("""SELECT doc_id fid, n > 0 AND doc_id % 9 <> 0 size_ok, (SELECT count(*) FROM (SELECT unnest(range(0, (n + 4095) // 4096)) i) WHERE (doc_id + i) % 11 = 0) n_bad FROM (SELECT doc_id, strlen(text) n FROM documents)""")
def scrub(s, d):
    f = _files(s, d)
    padded = integrity.checksums(integrity.blocks(f), integrity.BLOCK).withColumn("adler", F.col("adler") + ((F.col("fid") + F.col("block")) % 11 == 0).cast("long"))
    stored = padded.join(f.select("fid", (F.octet_length("data") + (F.col("fid") % 9 == 0).cast("int")).alias("size")), "fid")
    return integrity.scrub(f, stored)


@query("""SELECT doc_id chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'size' WHEN doc_id % 7 = 0 AND text <> 'x' THEN 'data' ELSE 'same' END state, md5(text) md5 FROM documents WHERE length(text) > 0""")
def replica_diff(s, d):
    f = table(s, d, "documents").where("length(text) > 0").select(F.col("doc_id").alias("chunk_id"), "text")
    two = f.where("chunk_id % 5 <> 0 and chunk_id % 7 = 0").select("chunk_id", F.lit(2).alias("server"), F.concat(F.unhex(F.lit("01")), F.expr("substring(CAST(text AS BINARY), 2, 1000000000)")).alias("data"))
    one = f.select("chunk_id", F.lit(1).alias("server"), F.col("text").cast("binary").alias("data"))
    longer = f.where("chunk_id % 5 = 0").select("chunk_id", F.lit(2).alias("server"), F.concat("text", F.lit("!")).cast("binary").alias("data"))
    equal = f.where("chunk_id % 5 <> 0 and chunk_id % 7 <> 0").select("chunk_id", F.lit(2).alias("server"), F.col("text").cast("binary").alias("data"))
    return integrity.compare_replicas(one.union(two).union(longer).union(equal))


@query("""SELECT o_orderkey k, CASE WHEN s < 1048576 THEN printf('%.2f KB', s / 1024) WHEN s < 1073741824 THEN printf('%.2f MB', s / 1048576) ELSE printf('%.2f GB', s / 1073741824) END size FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT * (o_orderkey % 100) s FROM orders)""")
def human_size(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), scalar.human_size(t.cents("o_totalprice") * (F.col("o_orderkey") % 100)).alias("size"))


@query("""SELECT o_orderkey k, CASE WHEN s > 1125899906842624 THEN printf('%.2f PB', s / 1125899906842624) WHEN s > 1099511627776 THEN printf('%.2f TB', s / 1099511627776) WHEN s > 1073741824 THEN printf('%.2f GB', s / 1073741824)
  WHEN s > 1048576 THEN printf('%.2f MB', s / 1048576) ELSE s::VARCHAR END size FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT * (o_orderkey % 1000) * (o_orderkey % 77) s FROM orders)""")
def bytes_readable(s, d):
    v = t.cents("o_totalprice") * (F.col("o_orderkey") % 1000) * (F.col("o_orderkey") % 77)
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), scalar.readable_bytes(v).alias("size"))


@query("SELECT s_suppkey server, (s_suppkey // 7 % 256)::INT rack FROM supplier")
def ip_rack(s, d):
    ip = F.concat_ws(".", F.lit("10"), F.lit("1"), F.expr("s_suppkey div 7 % 256").cast("string"), (F.col("s_suppkey") % 256).cast("string"))
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("server"), scalar.ip_rack(ip).alias("rack"))


@query("SELECT s_suppkey server, abs(s_suppkey - s_nationkey) distance FROM supplier")
def host_distance(s, d):
    a, b = (F.concat(F.lit("host-"), F.col(c).cast("string"), F.lit(".rack")) for c in ("s_suppkey", "s_nationkey"))
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("server"), scalar.host_distance(a, b).alias("distance"))


# ---------------------------------------------------------------- time and state
ROUNDS = 31


def _samples(s, d):
    e = t.events(s, d)
    return e.select(F.col("user_id").alias("target"), F.day("ts").cast("int").alias("day"), (F.day("ts") - 1).cast("int").alias("round"), F.col("value").alias("timetaken"), "us", "event_id")


EWMA = """SELECT target, round(sum(m * pow(0.5, 30 - r)), 6) ewma, sum(m * pow(0.5, 30 - r)) > 10 slow FROM (SELECT user_id target, day(ts) - 1 r, avg(value) m FROM events WHERE value >= 1e-6 GROUP BY 1, 2) GROUP BY 1"""


@query(EWMA)
def ewma_slow(s, d):
    return batch.slow_nodes(_samples(s, d), ROUNDS)


@query(with_(EV) + "SELECT user_id target, event_id id, us AS at, max(value) OVER (PARTITION BY user_id ORDER BY us, event_id) elapsed FROM ev")
def elapsed_monotone(s, d):
    return batch.elapsed_monotone(_samples(s, d).select("target", F.col("event_id").alias("id"), F.col("us").alias("at"), F.col("timetaken").alias("value")))


def _renewals(s, d):
    return t.events(s, d).select(F.col("user_id").alias("owner"), F.col("us").alias("at"), F.col("event_id").alias("id"))


ISL = with_(EV) + f""", g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY us, event_id) k FROM (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {LEASE}, true)::INT nw FROM ev)),
  il AS (SELECT user_id AS owner, min(us) start_at, max(us) last_at, count(*) n FROM g GROUP BY user_id, k)"""
AT = 1705363200000000
START = 1704067200000000


@query(ISL + " SELECT owner, start_at, last_at, n FROM il")
def lease_islands(s, d):
    return batch.lease_islands(_renewals(s, d), int(LEASE))


@query(ISL + f" SELECT owner, last_at + {LEASE} expires_at FROM il WHERE start_at <= {AT} AND {AT} <= last_at + {LEASE}")
def lease_valid_at(s, d):
    return batch.lease_valid_at(batch.lease_islands(_renewals(s, d), int(LEASE)), AT, int(LEASE))


@query(with_(EV) + f"SELECT user_id server, max(us) last_at, count(*) n_beats, {AT} - max(us) > 0 dead FROM ev GROUP BY 1")
def last_heard(s, d):
    return batch.last_heard(t.events(s, d).select(F.col("user_id").alias("server"), F.col("us").alias("at")), AT, 0)


@query(with_(EV) + f"SELECT user_id target, round(sum(least(100.0, greatest(value, 1.0) * 0.25) * pow(0.5, floor((1706745600000000 - us) / 86400000000))), 6) reserved FROM ev GROUP BY 1")
def reservation_decay(s, d):
    e = t.events(s, d).select(F.col("user_id").alias("target"), F.col("us").alias("at"), F.col("value").alias("size"))
    return batch.reservation_decay(e, 1706745600000000, 86400000000, 100)


@query(with_(RP, CH, EV) + f"""SELECT DISTINCT user_id fid, CASE WHEN bool_or(event_type = 'purchase') THEN 'write' ELSE 'read' END kind FROM ev WHERE us BETWEEN {AT} - {LEASE} AND {AT} AND event_type IN ('purchase', 'view') GROUP BY 1""")
def open_files(s, d):
    e = t.events(s, d).where(F.col("us").between(AT - int(LEASE), AT) & F.col("event_type").isin("purchase", "view"))
    return e.groupBy(F.col("user_id").alias("fid")).agg(F.when(F.bool_or(F.col("event_type") == "purchase"), "write").otherwise("read").alias("kind"))


@query("""SELECT user_id server, count(*) FILTER (event_type = 'click') click, count(*) FILTER (event_type = 'error') error, count(*) FILTER (event_type = 'purchase') purchase,
  count(*) FILTER (event_type = 'signup') signup, count(*) FILTER (event_type = 'view') AS "view" FROM events GROUP BY 1""")
def counters_csv(s, d):
    c = table(s, d, "events").groupBy(F.col("user_id").alias("server"), F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
    return sinks.counters_csv(c).fillna(0)


@query("SELECT event_type op, count(*) n, round(sum(value), 2) total_time FROM events GROUP BY 1")
def rpc_counters(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total_time"))


@query(with_(CH, RP, SV) + "SELECT chunk_id, fid, 'host' || server AS host, 20000 AS port, rack FROM rp JOIN ch USING (chunk_id) JOIN sv USING (server)")
def chunk_map_round_trip(s, d):
    lines = sinks.chunk_map_lines(t.chunks(s, d), t.replicas(s, d), t.servers(s, d))
    return text.parse_chunk_map(lines, "line")


@query(with_(CH, RP, SV) + """, z AS (SELECT l_orderkey chunk_id, l_suppkey server, max(l_linenumber * 1000) size FROM lineitem WHERE l_linenumber % 3 > 0 GROUP BY 1, 2)
  SELECT chunk_id, fid, 'host' || server AS host, 20000 AS port, rack, coalesce(z.size, 0)::BIGINT size FROM rp JOIN ch USING (chunk_id) JOIN sv USING (server) LEFT JOIN z USING (chunk_id, server)""")
def chunk_size_merge(s, d):
    listed = table(s, d, "lineitem").where("l_linenumber % 3 > 0").join(t.chunks(s, d).select(F.col("chunk_id").alias("l_orderkey"), "fid"), "l_orderkey")
    host = F.concat(F.lit("host"), F.col("l_suppkey").cast("string"))
    listing = listed.select(F.col("l_orderkey").alias("chunk_id"), "fid", host.alias("host"), F.lit(20000).alias("port"), (F.col("l_linenumber") * 1000).cast("long").alias("size"))
    there = chunk_map_round_trip(s, d)
    return health.with_sizes(there, listing).select("chunk_id", "fid", "host", "port", "rack", "size")


@query(with_(EV) + "SELECT event_id, concat(us // 1000000, '/', us % 1000000) stamp, strftime(ts, '%a %b ') || lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, ' %H:%M:%S %Y') AS \"text\" FROM ev")
def time_format(s, d):
    return t.events(s, d).select("event_id", scalar.sec_usec("us").alias("stamp"), scalar.time_text("us").alias("text"))


#: When the read and the write lease of a chunk expire, request by request.
GRANTS = f"""rq AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) k, CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' ELSE 'renew' END kind FROM ev WHERE event_type IN ('view', 'purchase', 'click')),
  q AS (SELECT user_id, 0::BIGINT event_id, 0::BIGINT k, NULL::BIGINT r, NULL::BIGINT w, NULL::VARCHAR error FROM (SELECT DISTINCT user_id FROM rq) UNION ALL
    SELECT user_id, event_id, k, CASE WHEN kind = 'read' AND error IS NULL THEN us + {LEASE} WHEN kind = 'renew' AND w IS NULL AND error IS NULL THEN us + {LEASE} WHEN kind = 'renew' AND w IS NULL AND error = 'ELEASEEXPIRED' THEN NULL ELSE r END,
      CASE WHEN kind = 'write' AND error IS NULL THEN us + {LEASE} WHEN kind = 'renew' AND w IS NOT NULL AND error IS NULL THEN us + {LEASE} WHEN kind = 'renew' AND w IS NOT NULL AND error = 'ELEASEEXPIRED' THEN NULL ELSE w END, error FROM (
    SELECT rq.user_id, rq.event_id, rq.k, kind, us, r, w, CASE WHEN kind = 'renew' THEN CASE WHEN coalesce(w, r) IS NULL THEN 'ENOENT' WHEN us > coalesce(w, r) THEN 'ELEASEEXPIRED' END
      WHEN us <= w OR (kind = 'write' AND us <= r) OR us < {START} + {LEASE} THEN 'EBUSY' END error FROM q JOIN rq ON rq.user_id = q.user_id AND rq.k = q.k + 1))"""


@query(with_(EV, GRANTS, recursive=True) + "SELECT event_id, coalesce(error, 'OK') outcome FROM q WHERE k > 0")
def lease_outcomes(s, d):
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "write").otherwise("renew")
    e = t.events(s, d).where(F.col("event_type").isin("view", "purchase", "click"))
    order = F.concat(F.lpad(F.col("us").cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    asked = e.select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("id"), order.alias("order"), F.col("us").alias("at"), kind.alias("kind"))
    return batch.lease_outcomes(asked, int(LEASE), START).select(F.col("id").alias("event_id"), F.coalesce("error", F.lit("OK")).alias("outcome"))


def _event_stream(s, d):
    f = table(s, d, "events")
    return live.read_stream(s, f"{d}/events.parquet*", f.schema)  # one file or a folder of them


@query(EWMA)
def stream_ewma(s, d):
    e = _event_stream(s, d).select(F.col("user_id").alias("target"), (F.day("ts") - 1).cast("long").alias("round"), F.col("value").alias("timetaken"))
    return live.ewma_at(live.drain(live.slow_nodes(e), "update"), ROUNDS)


@query(ISL + " SELECT owner, start_at, last_at, n FROM il")
def stream_leases(s, d):
    e = _event_stream(s, d).select(F.col("user_id").alias("owner"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return live.current_leases(live.drain(live.leases(e, int(LEASE)), "update"))


@query("SELECT user_id, event_type, count(*) n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedup(s, d):
    e = _event_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    once = live.drop_duplicates(e.unionByName(e.where("event_id % 3 = 0")), "ts", "40 days", "event_id")
    return live.drain(once, "append").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
