"""Logical inputs derived from the driver's tables: records, chunks, servers, namespace, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import pack_attempt
from tidemark.session import table

CHUNK_SIZE = 1 << 26
PARTITIONS = 8
MAPPERS = 16
#: Number of the root directory; other numbers are level * LEVEL + key.
ROOT = 2
LEVEL = 10**9


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed records ``(part, mapper, retry, attempt, seq, key, qty, rec_len)`` of line items."""
    li = table(spark, sf_dir, "lineitem")
    r = li.withColumns(
        {
            "part": (F.col("l_suppkey") % PARTITIONS).cast("int"),
            "mapper": F.col("l_partkey") % MAPPERS,
            "retry": (F.col("l_linenumber") % 2).cast("long"),
            "key": F.lpad(F.col("l_orderkey").cast("string"), 10, "0"),
            "qty": F.col("l_quantity"),
            "rec_len": (F.col("l_linenumber") + 64).cast("long"),
        }
    ).withColumn("attempt", pack_attempt("mapper", "retry"))
    w = W.partitionBy("attempt", "part").orderBy(*li.columns)
    return r.withColumn("seq", F.row_number().over(w) - F.lit(1).cast("long")).select("part", "mapper", "retry", "attempt", "seq", "key", "qty", "rec_len")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chunk_id, fid, offset, version, size)``: orders as chunks of their customer's file."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("fid"), ((F.row_number().over(w) - 1).cast("long") * CHUNK_SIZE).alias("offset"),
        (F.col("o_orderkey") % 5 + 1).alias("version"), cents("o_totalprice").alias("size"),
    )


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chunk_id, server)``: who hosts which chunk."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("server")).distinct()


def servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(server, rack, used, total, util)``."""
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("server")).agg(F.sum("l_quantity").cast("long").alias("used"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("server"), F.col("s_nationkey").alias("rack"))
    s = s.join(used, "server", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    s = s.withColumn("total", F.lit(20000).cast("long") * (F.col("server") % 5 + 1))
    return s.withColumn("util", F.when(F.col("total") == 0, 0.0).otherwise(F.col("used") / F.col("total")))


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespace ``(fid, parent, name, type, size, mtime)``: region, nation, customer, order."""

    def level(name, fid, n, parent, label, kind="dir", size=None, mtime=None):
        up = F.lit(ROOT).cast("long") if parent is None else F.col(parent).cast("long") + (n - 1) * LEVEL
        return table(spark, sf_dir, name).select(
            (F.col(fid).cast("long") + n * LEVEL).alias("fid"), up.alias("parent"), label.alias("name"), F.lit(kind).alias("type"),
            (F.lit(0).cast("long") if size is None else size).alias("size"), (F.lit(0).cast("long") if mtime is None else mtime).alias("mtime"),
        )

    files = level("orders", "o_orderkey", 4, "o_custkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), "file", cents("o_totalprice"), seconds("o_orderdate"))
    return (
        level("region", "r_regionkey", 1, None, F.col("r_name"))
        .unionByName(level("nation", "n_nationkey", 2, "n_regionkey", F.col("n_name")))
        .unionByName(level("customer", "c_custkey", 3, "c_nationkey", F.col("c_name")))
        .unionByName(files)
    )


def seconds(column: str) -> Column:
    return F.unix_seconds(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a numeric time ``us`` (microseconds)."""
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


#: Which operation an event stands for in the derived operation log.
OPS = {"signup": "create", "view": "setmtime", "click": "size", "purchase": "setrep", "error": "remove"}


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seqno, line)``: the events as slash-separated log lines, in the order of time."""
    e = events(spark, sf_dir)
    user, id_, ts = (F.col(c).cast("string") for c in ("user_id", "event_id", "us"))
    amount = F.round(F.col("value") * 100).cast("long").cast("string")
    line = (
        F.when(F.col("event_type") == "signup", F.concat_ws("/", F.lit("create"), F.lit("dir"), F.lit("2"), F.lit("name"), F.concat(F.lit("u"), user), F.lit("id"), user, F.lit("numReplicas"), F.lit("3"), F.lit("ctime"), ts))
        .when(F.col("event_type") == "view", F.concat_ws("/", F.lit("setmtime"), F.lit("file"), user, F.lit("mtime"), ts))
        .when(F.col("event_type") == "click", F.concat_ws("/", F.lit("size"), F.lit("file"), user, F.lit("filesize"), amount))
        .when(F.col("event_type") == "purchase", F.concat_ws("/", F.lit("setrep"), F.lit("file"), user, F.lit("replicas"), (F.col("event_id") % 5 + 1).cast("string")))
        .otherwise(F.concat_ws("/", F.lit("remove"), F.lit("dir"), F.lit("2"), F.lit("name"), F.concat(F.lit("u"), user)))
    )
    return e.select("us", F.col("event_id"), line.alias("line"))
