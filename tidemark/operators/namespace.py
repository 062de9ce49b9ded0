"""Namespace queries over ``nodes(fid, parent, name, type, size, mtime)``, and chunk layout.

Directories are few beside files. Whatever climbs the tree therefore first brings files to their
directory (one aggregation) and climbs over directories only, to any depth by doubling the way
that is known; a path is made once per directory. ``.`` and ``..`` are not stored. Unknown sizes are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.keyed import positions
from tidemark.session import materialise


def directories(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'dir'")


def _doubled(state: DataFrame, n: int, join: Callable[[DataFrame, DataFrame], DataFrame]) -> Iterator[DataFrame]:
    """``state`` (with ``fid`` and ``at``, a node above) after each doubling of the way up to ``at``.

    Ends when no ``at`` is a ``fid``: after about log2 of the depth rounds, each of them written.
    More than ``n`` levels on ``n`` directories are a cycle, which fails.
    """
    far = 1
    while True:
        state = materialise(state, "level")
        yield state
        if state.join(state.select(F.col("fid").alias("at")), "at", "left_semi").isEmpty():
            return
        if far > n:
            raise ValueError("directories form a cycle")
        state, far = join(state, state.select(F.col("fid").alias("at"), *[F.col(c).alias(f"_{c}") for c in state.columns if c != "fid"])), far * 2


def closure(nodes: DataFrame, root: int) -> DataFrame:
    """``(fid, ancestor, depth)`` over directories: each with itself (depth 0) and all above it."""
    dirs = directories(nodes)
    top = nodes.sparkSession.createDataFrame([(root, root, 0)], "fid long, ancestor long, depth int")
    out = dirs.select("fid", F.col("fid").alias("ancestor"), F.lit(0).alias("depth")).unionByName(top)
    out = materialise(out, "closure")
    jumps = dirs.select("fid", F.col("parent").alias("at"))
    for k, jump in enumerate(_doubled(jumps, dirs.count(), lambda s, t: s.join(t, "at").select("fid", F.col("_at").alias("at")))):
        more = jump.join(out.withColumnRenamed("fid", "at"), "at").select("fid", "ancestor", (F.col("depth") + (1 << k)).alias("depth"))
        out = out.unionByName(materialise(more, "closure"))
    return out


def directory_paths(nodes: DataFrame, root: int) -> DataFrame:
    """``(fid, path)`` of every directory that the root reaches; the root's path is empty."""
    dirs = directories(nodes)
    each = dirs.select("fid", F.col("parent").alias("at"), F.concat(F.lit("/"), "name").alias("path"))

    def longer(s: DataFrame, t: DataFrame) -> DataFrame:
        return s.join(t, "at", "left").select("fid", F.coalesce("_at", "at").alias("at"), F.concat(F.coalesce("_path", F.lit("")), "path").alias("path"))

    *_, last = _doubled(each, dirs.count(), longer)
    return last.where(F.col("at") == root).select("fid", "path").unionByName(nodes.sparkSession.createDataFrame([(root, "")], "fid long, path string"))


def paths(nodes: DataFrame, root: int) -> DataFrame:
    """``(fid, path, type, size, mtime)`` of every node that the root reaches."""
    at = directory_paths(nodes, root).select(F.col("fid").alias("parent"), F.col("path").alias("_p"))
    return nodes.join(at, "parent").select("fid", F.concat("_p", F.lit("/"), "name").alias("path"), "type", "size", "mtime")


def lookup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Attributes of ``wanted(parent, name)``; names that do not exist give no row."""
    return wanted.join(nodes, ["parent", "name"]).select("parent", "name", "fid", "type", "size", "mtime")


def lookup_paths(nodes: DataFrame, wanted: DataFrame, root: int) -> DataFrame:
    """Attributes of ``wanted(path)``: the path of the directory, then the name in it."""
    names = F.filter(F.split("path", "/"), lambda x: x != "")
    w = wanted.select("path", names.alias("_n")).where(F.size("_n") > 0)
    above = F.array_join(F.transform(F.slice("_n", 1, F.size("_n") - 1), lambda x: F.concat(F.lit("/"), x)), "")
    w = w.select("path", above.alias("_p"), F.element_at("_n", -1).alias("name"))
    at = directory_paths(nodes, root).select(F.col("fid").alias("parent"), F.col("path").alias("_p"))
    return w.join(at, "_p").join(nodes, ["parent", "name"]).select("path", "fid", "type", "size", "mtime")


def readdir(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    return nodes.join(parents.select(F.col("fid").alias("parent")), "parent", "left_semi").select("parent", "name")


def readdirplus(nodes: DataFrame, parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Names with attributes; files also with chunk count and the last chunk's id and offset."""
    rows = nodes.join(parents.select(F.col("fid").alias("parent")), "parent", "left_semi")
    last = chunks.groupBy("fid").agg(F.count("*").alias("chunk_count"), F.max_by("chunk_id", "offset").alias("last_chunk"), F.max("offset").alias("last_offset"))
    return rows.join(last, "fid", "left").select("parent", "name", "fid", "type", "size", "mtime", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "last_chunk", "last_offset")


def is_descendant(nodes: DataFrame, pairs: DataFrame, root: int) -> DataFrame:
    """For ``pairs(fid, ancestor)`` of directories whether the one lies below the other."""
    below = closure(nodes, root).where("depth > 0").select("fid", "ancestor", F.lit(True).alias("_yes"))
    return pairs.join(below, ["fid", "ancestor"], "left").select("fid", "ancestor", F.coalesce("_yes", F.lit(False)).alias("descendant"))


def directory_totals(nodes: DataFrame, root: int) -> DataFrame:
    """``(fid, bytes, n_files, mtime)`` of whole subtrees: positive sizes count, newest times win."""
    files = nodes.where("type = 'file'").groupBy(F.col("parent").alias("fid")).agg(
        F.sum(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))).alias("b"), F.count("*").alias("n"), F.max(F.when(F.col("size") > 0, F.col("mtime"))).alias("t"))
    own = directories(nodes).select("fid", "mtime")
    each = closure(nodes, root).join(files, "fid", "left").join(own, "fid", "left")
    return each.groupBy(F.col("ancestor").alias("fid")).agg(
        F.sum(F.coalesce("b", F.lit(0))).alias("bytes"), F.sum(F.coalesce("n", F.lit(0))).alias("n_files"), F.max(F.greatest("t", "mtime")).alias("mtime"))


def apply_size_changes(totals: DataFrame, nodes: DataFrame, deltas: DataFrame, root: int) -> DataFrame:
    """``totals(fid, bytes)`` after ``deltas(parent, delta)``, added at every ancestor and never below 0."""
    sums = deltas.groupBy(F.col("parent").alias("fid")).agg(F.sum("delta").alias("delta"))
    up = closure(nodes, root).join(sums, "fid").groupBy(F.col("ancestor").alias("fid")).agg(F.sum("delta").alias("delta"))
    return totals.join(up, "fid", "left").select("fid", F.greatest(F.col("bytes") + F.coalesce("delta", F.lit(0)), F.lit(0)).alias("bytes"))


# ---------------------------------------------------------------- chunks of files
def layout(chunks: DataFrame, replicas: DataFrame) -> DataFrame:
    """Chunks of each file with the sorted servers that have them."""
    at = replicas.groupBy("chunk_id").agg(F.array_sort(F.collect_set("server")).alias("servers"))
    return chunks.join(at, "chunk_id", "left").select("fid", "offset", "chunk_id", "version", F.coalesce("servers", F.array().cast("array<bigint>")).alias("servers"))


def chunk_at(chunks: DataFrame, wanted: DataFrame, chunk_size: int) -> DataFrame:
    """The chunk that holds each ``wanted(fid, pos)``."""
    w = wanted.withColumn("offset", F.col("pos") - F.pmod(F.col("pos"), F.lit(chunk_size)))
    return w.join(chunks, ["fid", "offset"]).select("fid", "pos", "chunk_id", "version")


def data_location(chunks: DataFrame, replicas: DataFrame, ranges: DataFrame, chunk_size: int) -> DataFrame:
    """Chunks and servers that ``ranges(fid, start, len)`` touch, the last chunk included."""
    hit = ranges.join(chunks, "fid").where((F.col("offset") < F.col("start") + F.col("len")) & (F.col("offset") + chunk_size > F.col("start")))
    n = replicas.groupBy("chunk_id").agg(F.array_sort(F.collect_set("server")).alias("servers"))
    return hit.join(n, "chunk_id", "left").select("fid", "start", "chunk_id", "offset", F.coalesce("servers", F.array().cast("array<bigint>")).alias("servers"))


def read_blocks(blocks: DataFrame, extents: DataFrame, block: int, fill: bool = True) -> DataFrame:
    """Blocks of sparse files ``(fid, offset, data)`` up to ``extents(fid, size)``; holes read as zeros.

    With ``fill`` false holes are left out.
    """
    if not fill:
        return blocks.join(extents, "fid").where("offset < size").select("fid", "offset", "data")
    grid = extents.where("size > 0").select("fid", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("offset"))
    n = F.least(F.lit(block).cast("long"), F.col("size") - F.col("offset")).cast("int")
    return grid.join(blocks, ["fid", "offset"], "left").select("fid", "offset", F.coalesce("data", F.unhex(F.repeat(F.lit("00"), n))).alias("data"))


def truncate(chunks: DataFrame, cuts: DataFrame, chunk_size: int) -> DataFrame:
    """Chunks left after ``cuts(fid, size)``, and whether the cut falls in a hole.

    Chunks from the cut on go; ``allocate`` is true on files that have no chunk at the cut.
    """
    c = chunks.join(cuts, "fid", "left").withColumn("_edge", F.col("size_cut") - F.pmod("size_cut", F.lit(chunk_size)))
    there = F.max((F.col("offset") == F.col("_edge")).cast("int")).over(W.partitionBy("fid"))
    c = c.withColumn("allocate", F.col("size_cut").isNotNull() & (F.pmod("size_cut", F.lit(chunk_size)) > 0) & (F.coalesce(there, F.lit(0)) == 0))
    return c.where("size_cut is null or offset < size_cut").select("fid", "offset", "chunk_id", "allocate")


def prune_head(chunks: DataFrame, cuts: DataFrame, chunk_size: int) -> DataFrame:
    """``(fid, offset, chunk_id, chunk_count)`` without chunks before the chunk of ``cuts(fid, head)``."""
    c = chunks.join(cuts, "fid", "left")
    keep = F.col("head").isNull() | (F.col("offset") >= F.col("head") - F.pmod("head", F.lit(chunk_size)))
    return c.where(keep).select("fid", "offset", "chunk_id", F.count("*").over(W.partitionBy("fid")).alias("chunk_count"))


def allocate(chunks: DataFrame, wanted: DataFrame, chunk_size: int) -> DataFrame:
    """``(fid, id, offset, chunk_id, version, outcome)`` of ``wanted(fid, id, offset, chunk_id)``.

    An offset of -1 appends: behind the last chunk of the file and behind earlier appends, in
    order of ``id``. Other offsets must be multiples of the chunk size, else ``EINVAL``; where a
    chunk is there, it stays and its version rises (``EEXIST``). Not two requests for one offset.
    """
    end = chunks.groupBy("fid").agg((F.max("offset") + chunk_size).alias("_end"))
    place = F.row_number().over(W.partitionBy("fid", F.col("offset") == -1).orderBy("id")) - 1
    given = wanted.where("offset >= 0").groupBy("fid").agg((F.max(F.when(F.pmod("offset", F.lit(chunk_size)) == 0, F.col("offset"))) + chunk_size).alias("_given"))
    w = wanted.withColumn("_k", place).join(end, "fid", "left").join(given, "fid", "left")
    behind = F.coalesce(F.greatest("_end", "_given"), F.lit(0)) + F.col("_k") * chunk_size
    w = w.withColumn("offset", F.when(F.col("offset") == -1, behind).otherwise(F.col("offset"))).withColumnRenamed("chunk_id", "_new")
    j = w.join(chunks.select("fid", "offset", "chunk_id", "version"), ["fid", "offset"], "left")
    bad, there = F.pmod("offset", F.lit(chunk_size)) != 0, F.col("chunk_id").isNotNull()
    return j.select(
        "fid", "id", "offset", F.when(~bad, F.coalesce("chunk_id", "_new")).alias("chunk_id"), F.when(~bad, F.coalesce(F.col("version") + 1, F.lit(1))).alias("version"),
        F.when(bad, "EINVAL").when(there, "EEXIST").otherwise("OK").alias("outcome"))


def ordered(paths_: DataFrame) -> DataFrame:
    """``paths_`` with ``pos``, the place from 0 of each path in byte order: a listing in order, in ranges."""
    return positions(paths_.withColumn("_all", F.lit(0)), "_all", "path").drop("_all")


def coalesce_blocks(chunks: DataFrame, moves: DataFrame, chunk_size: int) -> DataFrame:
    """Chunks after ``moves(src, dst)``: all of src behind the last chunk of dst. One move a file."""
    end = chunks.groupBy(F.col("fid").alias("dst")).agg((F.max("offset") + chunk_size).alias("_end"))
    m = moves.where("src <> dst").join(end, "dst", "left").select(F.col("src").alias("fid"), "dst", F.coalesce("_end", F.lit(0)).alias("_end"))
    c = chunks.join(m, "fid", "left")
    return c.select(F.coalesce("dst", "fid").alias("fid"), (F.col("offset") + F.coalesce("_end", F.lit(0))).alias("offset"), "chunk_id", "version")


def set_replication(nodes: DataFrame, dirs: DataFrame, replication: Column, root: int) -> DataFrame:
    """``(fid, replication)`` of all files below ``dirs(fid)``."""
    below = closure(nodes, root).join(dirs.select(F.col("fid").alias("ancestor")), "ancestor", "left_semi").select(F.col("fid").alias("parent")).distinct()
    return nodes.where("type = 'file'").join(below, "parent", "left_semi").select("fid", replication.alias("replication"))
