"""Block checksums and replica comparison.

Bytes are cut into fixed blocks; each has an Adler-32. Checksums over long blocks run as an
Arrow-batched pandas function over zlib; ``functions.scalar.adler32`` is the same in SQL alone.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

BLOCK = 4096


@F.pandas_udf(LongType())
def adler32_fast(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.adler32(b)).astype("Int64")


def blocks(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(fid, block, data)`` of ``files(fid, data)``; an empty file has no block."""
    n = F.ceil(F.octet_length("data") / F.lit(block)).cast("int")
    f = files.where(F.octet_length("data") > 0).withColumn("block", F.explode(F.sequence(F.lit(0), n - 1)))
    return f.select("fid", "block", F.substring("data", F.col("block") * block + 1, F.lit(block)).alias("data"))


def checksums(blocks_: DataFrame, pad_to: int | None = None) -> DataFrame:
    """``(fid, block, adler)``; with ``pad_to`` a short block counts as filled with zeros."""
    data: Column = F.col("data")
    if pad_to:
        data = F.concat(data, F.unhex(F.repeat(F.lit("00"), F.lit(pad_to) - F.octet_length(data))))
    return blocks_.select("fid", "block", adler32_fast(data).alias("adler"))


def mismatches(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Blocks whose checksums differ or that only one side has."""
    j = stored.withColumnRenamed("adler", "stored").join(computed.withColumnRenamed("adler", "computed"), ["fid", "block"], "full_outer")
    return j.where("NOT (stored <=> computed)").select("fid", "block", "stored", "computed")


def first_bad_block(stored: DataFrame, computed: DataFrame, versions: DataFrame) -> DataFrame:
    """``(fid, status, block)``; a version that differs is found before any checksum is looked at."""
    bad = mismatches(stored, computed).groupBy("fid").agg(F.min("block").alias("block"))
    v = versions.join(bad, "fid", "left")
    wrong = F.col("wanted") != F.col("has")
    return v.select("fid", F.when(wrong, "EBADVERS").when(F.col("block").isNotNull(), "EBADCKSUM").otherwise("OK").alias("status"), F.when(~wrong, F.col("block")).alias("block"))


def scrub(files: DataFrame, stored: DataFrame, block: int = BLOCK, share: float = 1.0, seed: int = 42) -> DataFrame:
    """``(fid, size_ok, n_bad)`` of all files, or of a hash-chosen share of them.

    ``stored(fid, size, block, adler)``; tails count as padded to a whole block.
    """
    if share < 1.0:
        files = files.where(F.pmod(F.xxhash64("fid", F.lit(seed)), F.lit(10**6)) < int(share * 10**6))
    now = checksums(blocks(files, block), block)
    bad = mismatches(stored.select("fid", "block", "adler").join(files.select("fid"), "fid", "left_semi"), now).groupBy("fid").agg(F.count("*").alias("n_bad"))
    size = stored.groupBy("fid").agg(F.max("size").alias("size"))
    f = files.select("fid", F.octet_length("data").alias("now")).join(size, "fid", "left").join(bad, "fid", "left")
    return f.select("fid", F.coalesce(F.col("now") == F.col("size"), F.lit(False)).alias("size_ok"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def file_md5(files: DataFrame) -> DataFrame:
    return files.select("fid", F.md5("data").alias("md5"))


def compare_replicas(copies: DataFrame) -> DataFrame:
    """``copies(chunk_id, server, data)``: whether all equal the copy on the first server, and its MD5."""
    c = copies.select("chunk_id", F.struct("server", F.octet_length("data").alias("size"), F.md5("data").alias("md5")).alias("c"))
    c = c.groupBy("chunk_id").agg(F.min("c").alias("a"), F.count_distinct("c.size").alias("sizes"), F.count_distinct("c.md5").alias("sums"))
    state = F.when(F.col("sizes") > 1, "size").when(F.col("sums") > 1, "data").otherwise("same")
    return c.select("chunk_id", state.alias("state"), F.col("a.md5").alias("md5"))
