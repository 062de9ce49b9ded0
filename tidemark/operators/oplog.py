"""Operation logs and checkpoints: parsing, replay, snapshots, compaction.

Log lines are ``op/tag/value/...``. Operations that commute between files (``size``, ``setmtime``,
``setrep``) replay as last writer wins, one aggregation. The order-dependent ones (create over an
existing name, remove, rename) are folded in sequence: subtrees are sorted side by side, and a
task reads them batch by batch with the state of one subtree in hand. Chunks of files replay by
windows, without a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """``(log_no, block, line_no, line)`` of text logs ``name.N``; the first three are the order of replay.

    N is a number, so ``log.10`` comes after ``log.9``; logs before ``since`` (the checkpoint's) are
    left out. ``block`` is where the part of the file that a task reads begins, and ``line_no``
    rises inside it.
    """
    t = spark.read.text(path).select(
        F.regexp_extract("_metadata.file_name", r"([0-9]+)$", 1).try_cast("long").alias("log_no"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return t.where(F.col("log_no") >= since)


def parse(lines: DataFrame) -> DataFrame:
    """Lines plus ``op`` and ``args`` (tag to value). Lines without a pair after the op give no args."""
    p = F.split("line", "/")
    tags = F.filter(F.slice(p, 2, F.size(p)), lambda x, i: i % 2 == 0)
    values = F.filter(F.slice(p, 2, F.size(p)), lambda x, i: i % 2 == 1)
    n = F.size(values)
    return lines.withColumn("op", F.get(p, F.lit(0))).withColumn("args", F.map_from_arrays(F.slice(tags, 1, n), values))


def arg(name: str, kind: str = "long"):
    return F.try_element_at("args", F.lit(name)).cast(kind)


def replay_last_writer(ops: DataFrame) -> DataFrame:
    """``(fid, filesize, mtime, replicas)`` after the commuting operations, by last ``seqno``."""
    o = ops.where(F.col("op").isin("size", "setmtime", "setrep")).withColumn("fid", arg("file"))

    def last(op, tag):
        return F.max_by(F.when(F.col("op") == op, arg(tag)), F.when(F.col("op") == op, F.col("seqno")))

    return o.groupBy("fid").agg(last("size", "filesize").alias("filesize"), last("setmtime", "mtime").alias("mtime"), last("setrep", "replicas").alias("replicas"))


STATE = "fid long, name string, replicas long, ctime long, mtime long, filesize long"


def replay(ops: DataFrame, by: str = "tree") -> DataFrame:
    """The files left after all operations, in order of ``seqno``.

    ``by`` names an independent subtree: no operation reaches out of its group. A create over an
    existing name removes the old file first; operations on a file that is not there are ignored.
    """
    flat = ops.select(by, "seqno", "op", arg("id").alias("id"), arg("file").alias("file"), F.try_element_at("args", F.lit("name")).alias("name"),
                      F.try_element_at("args", F.lit("old")).alias("old"), F.try_element_at("args", F.lit("new")).alias("new"),
                      arg("numReplicas").alias("n"), arg("ctime").alias("ctime"), arg("mtime").alias("mtime"), arg("filesize").alias("filesize"), arg("replicas").alias("replicas"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        files: dict[int, dict] = {}
        names: dict[str, int] = {}
        for r in pdf.sort_values("seqno").to_dict("records"):
            op = r["op"]
            if op == "create":
                files.pop(names.get(r["name"]), None)
                names[r["name"]] = int(r["id"])
                files[int(r["id"])] = {"fid": int(r["id"]), "name": r["name"], "replicas": int(r["n"]), "ctime": int(r["ctime"]), "mtime": int(r["ctime"]), "filesize": None}
            elif op == "remove":
                files.pop(names.pop(r["name"], None), None)
            elif op == "rename" and r["old"] in names:
                fid = names.pop(r["old"])
                files.pop(names.get(r["new"]), None)
                names[r["new"]] = fid
                files[fid]["name"] = r["new"]
            elif op in ("size", "setmtime", "setrep") and not pd.isna(r["file"]) and int(r["file"]) in files:
                tag = {"size": "filesize", "setmtime": "mtime", "setrep": "replicas"}[op]
                files[int(r["file"])][tag] = int(r[tag])
        return pd.DataFrame(list(files.values()), columns=["fid", "name", "replicas", "ctime", "mtime", "filesize"]).astype({"filesize": "Int64"})

    return flat.groupBy(by).applyInPandas(fold, STATE)


def fold_sorted(ops: DataFrame, by: str, order: str, fold: Callable[[], Callable], schema: str) -> DataFrame:
    """Fold the rows of each ``by`` in ``order``; ``fold()`` makes the state of one.

    The state is called with each row (a named tuple), and with None at the end of its ``by``; it
    returns a list of output rows. Rows stream through a task in batches, so a long ``by`` costs
    time but no memory beyond its state.
    """
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if state is None or getattr(r, by) != at:
                    out += state(None) if state else []
                    at, state = getattr(r, by), fold()
                out += state(r)
            yield pd.DataFrame(out, columns=names)
        if state:
            yield pd.DataFrame(state(None), columns=names)

    return ops.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, schema)


OUTCOME = "seqno string, error string, parent long, name string, type string, fid long"


def _names() -> Callable:
    """State of one subtree: entries ``(parent, name)`` and where each directory lies."""
    entry: dict[tuple[int, str], tuple[str, int]] = {}
    above: dict[int, int] = {}
    held: dict[int, int] = {}

    def put(at, kind, fid):
        entry[at] = (kind, fid)
        held[at[0]] = held.get(at[0], 0) + 1
        if kind == "dir":
            above[fid] = at[0]

    def drop(at):
        kind, fid = entry.pop(at)
        held[at[0]] -= 1
        if kind == "dir":
            above.pop(fid, None)
        return kind, fid

    def below(fid, top):
        while fid != top and fid in above:
            fid = above[fid]
        return fid == top

    def target(r):
        """Where a rename leads: a name in the same directory, or a path from the subtree's top."""
        *way, name = r.new.split("/")
        at = r.dir
        if way:
            at = r.top
            for step in filter(None, way):
                kind, at = entry.get((at, step), (None, None))
                if kind != "dir":
                    return ("ENOENT" if kind is None else "ENOTDIR"), None
        return ("EINVAL" if not name else None), (at, name)

    def apply(r):
        at = (r.dir, r.old if r.op == "rename" else r.name)
        kind, fid = entry.get(at, (None, None))
        if r.op in ("create", "mkdir"):
            if not r.name or "/" in r.name:
                return "EINVAL"
            if kind and (r.op == "mkdir" or (kind == "file" and r.exclusive == 1)):
                return "EEXIST"
            if kind == "dir":
                return "EISDIR"
            if kind:
                drop(at)
            put(at, "dir" if r.op == "mkdir" else "file", int(r.id))
        elif kind is None:
            return "ENOENT"
        elif r.op == "remove":
            if kind == "dir":
                return "EISDIR"
            drop(at)
        elif r.op == "rmdir":
            if kind == "file":
                return "ENOTDIR"
            if held.get(fid, 0):
                return "ENOTEMPTY"
            drop(at)
        else:
            error, to = target(r)
            if error or to == at:
                return error
            there, other = entry.get(to, (None, None))
            if there and there != kind:
                return "ENOTDIR" if kind == "dir" else "EISDIR"
            if there == "dir" and held.get(other, 0):
                return "ENOTEMPTY"
            if kind == "dir" and below(to[0], fid):
                return "EINVAL"
            if there:
                drop(to)
            put(to, *drop(at))
        return None

    def step(r):
        if r is None:
            return [(None, None, parent, name, kind, fid) for (parent, name), (kind, fid) in entry.items()]
        return [(r.seqno, apply(r), None, None, None, None)]

    return step


def replay_names(ops: DataFrame, by: str = "tree") -> DataFrame:
    """Outcomes and entries of ``create``, ``mkdir``, ``remove``, ``rmdir`` and ``rename`` in order of ``seqno``.

    ``ops(tree, seqno, op, args)``; ``by`` names an independent subtree, whose number is that of
    its top directory. Rows with a ``seqno`` are outcomes (``error`` is null where all went well);
    rows without are the entries at the end. A create replaces a file unless it is exclusive.
    """
    text = lambda n: F.try_element_at("args", F.lit(n))
    flat = ops.select(F.col(by).alias("top"), F.col("seqno").cast("string").alias("seqno"), "op", arg("dir").alias("dir"), text("name").alias("name"), arg("id").alias("id"),
                      text("old").alias("old"), text("new").alias("new"), F.coalesce(arg("exclusive", "int"), F.lit(0)).alias("exclusive"))
    names = flat.where(F.col("op").isin("create", "mkdir", "remove", "rmdir", "rename"))
    return fold_sorted(names, "top", "seqno", _names, OUTCOME)


def replay_chunks(ops: DataFrame, chunk_size: int) -> DataFrame:
    """``(fid, offset, chunk_id, version)`` after all allocations, cuts and version changes.

    A chunk stands if no later truncate is at or below its offset and no later prune is above it;
    its version is that of its last allocation or, later, of a ``chunkVersionInc``. A log names the
    same chunk again where it allocates one that is there.
    """
    o = ops.where(F.col("op").isin("allocate", "truncate", "pruneFromHead")).select("seqno", "op", arg("file").alias("fid"), arg("offset").alias("offset"), arg("chunkId").alias("chunk_id"), arg("chunkVersion").alias("version"))
    later = W.partitionBy("fid").orderBy("seqno").rowsBetween(1, W.unboundedFollowing)
    head = F.when(F.col("op") == "pruneFromHead", F.col("offset") - F.pmod("offset", F.lit(chunk_size)))
    o = o.withColumn("_cut", F.min(F.when(F.col("op") == "truncate", F.col("offset"))).over(later)).withColumn("_head", F.max(head).over(later))
    there = o.where("op = 'allocate' and offset < coalesce(_cut, offset + 1) and offset >= coalesce(_head, offset)")
    last = there.groupBy("fid", "offset").agg(F.max(F.struct("seqno", "chunk_id", "version")).alias("x")).select("fid", "offset", "x.*")
    newer = ops.where("op = 'chunkVersionInc'").select(F.col("seqno").alias("_s"), arg("file").alias("fid"), arg("chunkId").alias("chunk_id"), arg("chunkVersion").alias("_v"))
    j = last.join(newer, ["fid", "chunk_id"], "left")
    v = F.max(F.when(F.col("_s") > F.col("seqno"), F.struct("_s", "_v")))
    return j.groupBy("fid", "offset", "chunk_id", "version").agg(v.alias("_new")).select("fid", "offset", "chunk_id", F.coalesce("_new._v", "version").alias("version"))


def pending_stable(ops: DataFrame) -> DataFrame:
    """Chunks ``(chunk_id, version, size)`` whose last ``mkstable`` has no ``mkstabledone`` after it."""
    o = ops.where(F.col("op").isin("mkstable", "mkstabledone")).groupBy(arg("chunkId").alias("chunk_id"))
    last = o.agg(F.max(F.struct("seqno", "op", arg("chunkVersion").alias("version"), arg("size").alias("size"))).alias("x"))
    return last.where("x.op = 'mkstable'").select("chunk_id", "x.version", "x.size")


def checkpoint_lines(nodes: DataFrame, chunks: DataFrame, replicas: int = 3) -> DataFrame:
    """A snapshot as text lines: ``dentry``, ``fattr`` and ``chunkinfo``."""
    s = lambda c: F.col(c).cast("string")
    d = nodes.select(F.concat_ws("/", F.lit("dentry/name"), "name", F.lit("id"), s("fid"), F.lit("parent"), s("parent")).alias("line"))
    f = nodes.select(F.concat_ws("/", F.lit("fattr"), "type", F.lit("id"), s("fid"), F.lit("numReplicas"), F.lit(str(replicas)), F.lit("mtime"), s("mtime"), F.lit("filesize"), F.coalesce(s("size"), F.lit("-1"))).alias("line"))
    c = chunks.select(F.concat_ws("/", F.lit("chunkinfo/fid"), s("fid"), F.lit("chunkid"), s("chunk_id"), F.lit("offset"), s("offset"), F.lit("chunkVersion"), s("version")).alias("line"))
    return d.union(f).union(c)


def restore(lines: DataFrame, least_replicas: int = 1) -> DataFrame:
    """Files and directories of a snapshot; the chunk count is made from its chunks, -1 is null."""
    p = lines.withColumn("v", F.split("line", "/"))
    at = lambda i: F.get("v", F.lit(i))
    d = p.where(at(0) == "dentry").select(at(4).cast("long").alias("fid"), at(2).alias("name"), at(6).cast("long").alias("parent"))
    f = p.where(at(0) == "fattr").select(at(3).cast("long").alias("fid"), at(1).alias("type"), F.greatest(at(5).cast("long"), F.lit(least_replicas).cast("long")).alias("replicas"), at(7).cast("long").alias("mtime"), F.nullif(at(9).cast("long"), F.lit(-1)).alias("size"))
    c = p.where(at(0) == "chunkinfo").groupBy(at(2).cast("long").alias("fid")).agg(F.count("*").alias("chunk_count"))
    return d.join(f, "fid").join(c, "fid", "left").select("fid", "name", "parent", "type", "replicas", "mtime", "size", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def compact(state: DataFrame, later: DataFrame) -> DataFrame:
    """Snapshot ``state`` (as ``replay`` returns it) brought up to date by later commuting operations."""
    new = replay_last_writer(later).select("fid", F.col("filesize").alias("_s"), F.col("mtime").alias("_m"), F.col("replicas").alias("_r"))
    j = state.join(new, "fid", "left")
    return j.select("fid", "name", F.coalesce("_r", "replicas").alias("replicas"), "ctime", F.coalesce("_m", "mtime").alias("mtime"), F.coalesce("_s", "filesize").alias("filesize"))


def restore_mtimes(nodes: DataFrame, saved: DataFrame) -> DataFrame:
    """Nodes with the times of ``saved(fid, mtime)`` where there is one."""
    return nodes.join(saved.select("fid", F.col("mtime").alias("_m")), "fid", "left").withColumn("mtime", F.coalesce("_m", "mtime")).drop("_m")


def retained(logs: DataFrame, keep: int, min_age: int, now: int) -> DataFrame:
    """Logs ``(name, n, mtime)`` that may go: older than ``min_age`` and not among the newest ``keep``."""
    newest = logs.orderBy(F.desc("n")).limit(keep).select("name")
    return logs.where(F.lit(now) - F.col("mtime") > min_age).join(newest, "name", "left_anti").select("name")
