"""Readers of the small text formats around the data: servers, chunk maps, listings, status, properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def network_definition(spark: SparkSession, path: str) -> DataFrame:
    """``host port rack total used`` lines."""
    return spark.read.csv(path, sep=" ", schema="host string, port int, rack int, total long, used long", comment="#")


def parse_chunk_map(lines: DataFrame, column: str = "value") -> DataFrame:
    """``chunkid fid n (host port rack)*n`` lines, one row a replica; a chunk without one gives no row."""
    p = F.split(F.trim(column), " +")
    d = lines.select(F.get(p, F.lit(0)).cast("long").alias("chunk_id"), F.get(p, F.lit(1)).cast("long").alias("fid"), F.get(p, F.lit(2)).cast("int").alias("n"), p.alias("p")).where("n > 0")
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda k: F.get("p", 3 + 3 * F.col("i") + k)
    return d.select("chunk_id", "fid", at(0).alias("host"), at(1).cast("int").alias("port"), at(2).cast("int").alias("rack"))


def chunk_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_chunk_map(spark.read.text(path))


def parse_drive_listing(lines: DataFrame, column: str = "value") -> DataFrame:
    """``sizeKB fid.chunkid.version`` lines; others (the heads ``drive n``) are left out."""
    m = lambda i: F.regexp_extract(column, r"^\s*(\d+) (\d+)\.(\d+)\.(\d+)\s*$", i)
    d = lines.where(F.col(column).rlike(r"^\s*\d+ \d+\.\d+\.\d+\s*$"))
    return d.select((m(1).cast("long") * 1024).alias("size"), m(2).cast("long").alias("fid"), m(3).cast("long").alias("chunk_id"), m(4).cast("long").alias("version"))


def parse_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated servers of ``k=v, k=v`` lists, as maps."""
    one = F.explode(F.split(column, "\t")).alias("s")
    return lines.select(one).where("trim(s) <> ''").select(F.str_to_map(F.regexp_replace("s", r"\s*,\s*", ","), F.lit(","), F.lit("=")).alias("status"))


def properties(spark: SparkSession, path: str) -> dict[str, str]:
    """``key = value`` lines of a configuration file; ``#`` starts a comment. For the driver."""
    found = {}
    for row in spark.read.text(path).collect():  # a configuration file
        line = row[0].split("#", 1)[0]
        if "=" in line:
            k, v = line.split("=", 1)
            found[k.strip()] = v.strip()
    return found
