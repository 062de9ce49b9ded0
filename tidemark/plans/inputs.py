"""The derived inputs as DuckDB SQL, for the queries' equivalents."""

CS = 67108864
REC = """rec AS (SELECT (l_suppkey % 8)::INT part, l_partkey % 16 mapper, (l_linenumber % 2)::BIGINT retry,
  (((l_partkey % 16) << 32) | (l_linenumber % 2)::BIGINT) attempt,
  row_number() OVER (PARTITION BY l_partkey % 16, l_linenumber % 2, l_suppkey % 8 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 seq,
  lpad(l_orderkey::VARCHAR, 10, '0') AS key, l_quantity qty, (l_linenumber + 64)::BIGINT rec_len FROM lineitem)"""
CH = f"""ch AS (SELECT o_orderkey chunk_id, o_custkey fid, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * {CS})::BIGINT AS "offset",
  o_orderkey % 5 + 1 AS version, round(o_totalprice * 100)::BIGINT size FROM orders)"""
RP = "rp AS (SELECT DISTINCT l_orderkey chunk_id, l_suppkey server FROM lineitem)"
SV = """sv AS (SELECT s_suppkey server, s_nationkey rack, coalesce(u, 0)::BIGINT used, 20000 * (s_suppkey % 5 + 1) total, coalesce(u, 0)::BIGINT / (20000 * (s_suppkey % 5 + 1)) util
  FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity)::BIGINT u FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""
ND = """nd AS (SELECT r_regionkey + 1000000000 fid, 2::BIGINT parent, r_name AS name, 'dir' AS type, 0::BIGINT size, 0::BIGINT mtime FROM region
  UNION ALL SELECT n_nationkey + 2000000000::BIGINT, n_regionkey + 1000000000, n_name, 'dir', 0, 0 FROM nation
  UNION ALL SELECT c_custkey + 3000000000::BIGINT, c_nationkey + 2000000000::BIGINT, c_name, 'dir', 0, 0 FROM customer
  UNION ALL SELECT o_orderkey + 4000000000::BIGINT, o_custkey + 3000000000::BIGINT, 'o' || o_orderkey, 'file', round(o_totalprice * 100)::BIGINT, epoch(o_orderdate)::BIGINT FROM orders)"""
#: Directory, ancestor, depth.
CL = """cl AS (SELECT fid, fid AS ancestor, 0 AS depth FROM nd WHERE type = 'dir' UNION ALL
  SELECT cl.fid, nd.parent, depth + 1 FROM cl JOIN nd ON nd.fid = cl.ancestor)"""
#: Node and path.
PT = """pt AS (SELECT fid, '/' || name AS path, type, size, mtime FROM nd WHERE parent = 2 UNION ALL
  SELECT nd.fid, pt.path || '/' || nd.name, nd.type, nd.size, nd.mtime FROM pt JOIN nd ON nd.parent = pt.fid)"""
IX = """ix AS (SELECT part, attempt, rec_no, off AS "offset", key, rec_len FROM (SELECT *, row_number() OVER w - 1 rec_no,
  (sum(rec_len) OVER w - rec_len)::BIGINT off, lead(seq) OVER w IS NULL last FROM rec WINDOW w AS (PARTITION BY part, attempt ORDER BY key, seq)) WHERE rec_no % 16 = 0 OR last)"""
LIM = 65536
SZ = "sz AS (SELECT part, sum(rec_len)::BIGINT bytes FROM rec GROUP BY 1)"
#: Key ranges, with keys as hex.
PL = f"""k0 AS (SELECT DISTINCT part, hex(key) k FROM ix), k1 AS (SELECT part, k FROM k0 UNION ALL SELECT part, max(k) || '00' FROM k0 GROUP BY 1),
  k2 AS (SELECT part, k, row_number() OVER (PARTITION BY part ORDER BY k) - 1 i, count(*) OVER (PARTITION BY part) n FROM k1),
  k3 AS (SELECT k2.*, ceil(bytes / {LIM})::BIGINT t FROM k2 JOIN sz USING (part)),
  k4 AS (SELECT part, k, i, n, CASE WHEN n // t = 0 OR n = t THEN n - 1 ELSE t END t, CASE WHEN n // t = 0 OR n = t THEN 1 ELSE n // t END s FROM k3),
  pl AS (SELECT a.part, (a.i // a.s)::INT task, a.k low, b.k high FROM k4 a JOIN k4 b ON a.part = b.part AND a.i % a.s = 0 AND a.i // a.s < a.t
    AND b.i = CASE WHEN a.i // a.s = a.t - 1 THEN a.n - 1 ELSE least(a.n - 1, a.i + a.s) END)"""
EV = "ev AS (SELECT *, epoch_us(ts) us FROM events)"
LEASE = "43200000000"


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " "
