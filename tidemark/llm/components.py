"""Connected components of a link table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label the nodes of ``edges(a, b)`` with the smallest node they reach: ``(node, root)``.

    Alternates the large-star and small-star steps: each node's neighbours are re-linked to its
    smallest neighbour, which needs about log(diameter) rounds. Both steps are a min-aggregate
    (partial sums before the shuffle, so a hub costs one row a task) and an equi-join, and every
    round is written to the shared scratch folder. Self-links and nulls are ignored; an empty
    table gives an empty result; nodes without a link to another node are not returned.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = materialise(e, "links")
    before = _digest(e)
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # a node that is itself the smallest of its star keeps its links to larger ones (m = u)
        large = materialise(large.distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", "m"))
            .distinct()
        )
        e = materialise(small, "links")
        now = _digest(e)
        if now == before:
            return e.toDF("node", "root").union(e.select("b", "b").distinct())
        before = now
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")


def _digest(e: DataFrame) -> tuple:
    """Row count and order-free checksum of the links: equal before and after means settled."""
    return tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
