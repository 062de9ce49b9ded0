"""Writers: sorted runs, appends, text dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sorted_runs(records: DataFrame, path: str, partitions: int) -> None:
    """One folder a partition, files sorted by key, so row-group statistics serve as a sparse index."""
    records.repartition(partitions, "part").sortWithinPartitions("part", "key").write.mode("append").partitionBy("part").option("compression", "zstd").parquet(path)


def append_records(records: DataFrame, path: str) -> None:
    """Whole records or none: files of a failed task are never seen."""
    records.write.mode("append").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def chunk_map_lines(chunks: DataFrame, replicas: DataFrame, servers: DataFrame, chunks_a_task: int = 100_000) -> DataFrame:
    """``chunkid fid n (host port rack)*n`` lines; chunks without a replica included.

    The number of chunks says in how many parts copies are gathered.
    """
    parts = chunks.count() // chunks_a_task + 1
    r = replicas.join(servers.select("server", "rack"), "server")
    one = F.concat(F.lit("host"), F.col("server").cast("string"), F.lit(" 20000 "), F.col("rack").cast("string"))
    r = r.repartition(parts, "chunk_id").groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("server", one.alias("t")))), lambda x: x.t).alias("t"))
    c = chunks.repartition(parts, "chunk_id").join(r, "chunk_id", "left")
    n = F.coalesce(F.size("t"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n).cast("string")
    return c.select(F.concat_ws(" ", F.col("chunk_id").cast("string"), F.col("fid").cast("string"), n, F.array_join("t", " ")).alias("line"))


def counters_csv(counters: DataFrame) -> DataFrame:
    """``counters(server, name, value)`` as one row a server and one column a name, for a CSV sink."""
    names = sorted(r[0] for r in counters.select("name").distinct().collect())  # the columns
    return counters.groupBy("server").pivot("name", names).agg(F.sum("value"))


def sized_chunk_map_lines(sized: DataFrame) -> DataFrame:
    """``chunkid fid n (size host port rack)*n`` lines of ``sized(chunk_id, fid, host, port, rack, size)``."""
    one = F.concat_ws(" ", F.col("size").cast("string"), "host", F.col("port").cast("string"), F.col("rack").cast("string"))
    g = sized.groupBy("chunk_id", "fid").agg(F.array_sort(F.collect_list(F.struct("host", one.alias("t")))).alias("t"))
    return g.select(F.concat_ws(" ", F.col("chunk_id").cast("string"), F.col("fid").cast("string"), F.size("t").cast("string"), F.array_join(F.transform("t", lambda x: x.t), " ")).alias("line"))


def write_plan(moves: DataFrame, path: str) -> None:
    """A rebalance plan ``(chunk_id, src, dst)`` as move records that an executor reads in order of source."""
    moves.repartition("src").sortWithinPartitions("src", "chunk_id").write.mode("overwrite").parquet(path)
