"""Operator 3: mixing sources to target weights by Poisson replication. DataFrame functions only.

Every source s gets a mean repetition rate: characters wanted of it over characters there are,
``budget * weight(s) / chars(s)``. A document is repeated Poisson(rate) times; the count is the
inverse of the Poisson distribution at a uniform number made from a hash of seed and doc_id, so
it needs no state, is the same in every run, and an executor lost costs nothing but a recount.
Rates over ``PART`` are drawn as the sum of equal parts, each with a hash of its own, so that
exp(-rate) cannot underflow. Each copy then goes to the place of a hash of (seed, doc_id, copy):
a hash partition by that key, sorted inside, which is a global shuffle without one sorting task.

The rates are one row a source, from a sum with partial sums before its shuffle, so a source with
a third of all rows costs as much as any other. They are broadcast if there are at most
``MAX_BROADCAST`` sources, and joined by shuffle (which splits skewed keys) beyond.

Defined cases: a null source is a source of its own, named null; in ``weights`` it is "". Sources
without a weight, and documents of sources without a single character, get rate 0. A null doc_id
hashes as "". Rows that repeat a doc_id are repeated alike. Extra columns are carried along; the
columns ``copy`` and ``mix_key`` are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.names import free_prefix
from tidemark.session import materialise, table

SEED = 42
PART = 64.0
MAX_BROADCAST = 5000
POWER = 0.5


def _uniform(seed: int, *parts) -> Column:
    """In [0, 1), from the first 52 bits of an MD5."""
    return _bits(seed, *parts) / F.lit(float(1 << 52))


def _bits(seed: int, *parts) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, power: float = POWER) -> DataFrame:
    """``(source, chars, rate)`` for each source.

    ``weights`` are target shares of the output's characters (any scale); by default a source's
    share is its characters to the power ``power``. ``budget`` is the output's characters, by
    default the input's.
    """
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    if weights is None:
        size = size.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(power)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        size = size.withColumn("weight", F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))).cast("double"), F.lit(0.0)))
    size = materialise(size, "sizes")
    total = size.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars"))
    wanted = F.lit(float(budget)) if budget is not None else F.col("all_chars").cast("double")
    rate = F.when((F.col("chars") > 0) & (F.col("all_weight") > 0), wanted * F.col("weight") / F.col("all_weight") / F.col("chars")).otherwise(0.0)
    return size.crossJoin(F.broadcast(total)).select("source", "chars", rate.alias("rate"))  # total is one row


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated and shuffled, plus ``copy`` (1 on) and ``mix_key``."""
    cdf = """aggregate(sequence(1, CAST(ceil(part + 12 * sqrt(part) + 24) AS INT)),
        struct(exp(-part) AS p, array(exp(-part)) AS c),
        (a, k) -> struct(a.p * part / k AS p, concat(a.c, array(element_at(a.c, -1) + a.p * part / k)) AS c), a -> a.c)"""
    p = free_prefix(docs, "_m")
    per = (
        rates(docs, weights, budget)
        .withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
        .withColumn("part", F.col("rate") / F.col("parts"))
        .select(F.coalesce("source", F.lit("")).alias(f"{p}_key"), F.col("source").isNull().alias(f"{p}_null"), F.col("parts").alias(f"{p}_parts"), F.expr(cdf).alias(f"{p}_cdf"))
    )
    per = materialise(per, "rates")
    if per.count() <= MAX_BROADCAST:
        per = F.broadcast(per)
    d = docs.withColumns({f"{p}_key": F.coalesce("source", F.lit("")), f"{p}_null": F.col("source").isNull(), f"{p}_id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    d = d.join(per, [f"{p}_key", f"{p}_null"])
    draws = F.transform(F.sequence(F.lit(1), F.col(f"{p}_parts")), lambda j: _uniform(seed, F.col(f"{p}_id"), j.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col(f"{p}_cdf"), lambda c: c <= u)))
    d = d.withColumn(f"{p}_n", count).where(F.col(f"{p}_n") > 0).drop("copy", "mix_key", f"{p}_cdf", f"{p}_parts")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}_n"))))
    d = d.withColumn("mix_key", _bits(seed, F.col(f"{p}_id"), "copy", F.col("copy").cast("string")))
    kept = [c for c in docs.columns if c not in ("copy", "mix_key")]
    return d.select(*[F.col(f"`{c}`") for c in kept], "copy", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key", "copy")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op3_mix_sources": op3_mix_sources}
SQL = {
    "op3_mix_sources": """
    WITH s AS (SELECT source, sum(length(text))::BIGINT chars FROM documents GROUP BY 1),
    t AS (SELECT sum(sqrt(chars::DOUBLE)) w, sum(chars)::DOUBLE c FROM s),
    r AS (SELECT source, c * sqrt(chars::DOUBLE) / w / chars AS rate FROM s, t),
    p AS (SELECT source, greatest(ceil(rate / 64), 1)::INT parts, rate / greatest(ceil(rate / 64), 1) part FROM r),
    q AS (SELECT *, list_transform(range(0, ceil(part + 12 * sqrt(part) + 24)::INT + 1),
             lambda k: exp(-part + k * ln(part) - lgamma(k + 1))) pmf FROM p),
    cdf AS (SELECT source, parts, list_transform(range(1, len(pmf) + 1), lambda i: list_sum(pmf[1:i])) c FROM q),
    n AS (SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(c, lambda x:
             x <= ('0x' || substr(md5('42:' || d.doc_id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0)))) AS n
          FROM documents d JOIN cdf USING (source)),
    e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n::INT + 1))::INT AS copy FROM n)
    SELECT *, ('0x' || substr(md5('42:' || doc_id || ':copy:' || copy), 1, 13))::BIGINT AS mix_key FROM e""",
}
