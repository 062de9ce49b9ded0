"""Batch twins of the streaming operators: the same folds over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.oplog import fold_sorted

SLOW = 10.0
NOISE = 1e-6


def slow_nodes(samples: DataFrame, rounds: int, limit: float = SLOW) -> DataFrame:
    """``(target, ewma, slow)`` of ``samples(target, round, timetaken)`` after ``rounds`` rounds.

    Each round the average is halved and the round's mean is added, so a steady load settles at
    twice its mean. Times under a millionth are status reports and don't count.
    """
    each = samples.where(F.col("timetaken") >= NOISE).groupBy("target", "round").agg(F.avg("timetaken").alias("m"))
    each = each.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("round", "m"))).alias("m"))
    means = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0.0)))
    ewma = F.aggregate(means, F.lit(0.0), lambda a, x: a / 2 + x)
    return each.select("target", ewma.alias("e")).select("target", F.round("e", 6).alias("ewma"), (F.col("e") > limit).alias("slow"))


def elapsed_monotone(samples: DataFrame) -> DataFrame:
    """Elapsed times made non-decreasing in time order: ``(target, at, elapsed)``."""
    w = W.partitionBy("target").orderBy("at", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return samples.select("target", "id", "at", F.max("value").over(w).alias("elapsed"))


def lease_islands(renewals: DataFrame, interval: int) -> DataFrame:
    """``(owner, start_at, last_at, n)``: a renewal up to ``interval`` after the last keeps the lease."""
    w = W.partitionBy("owner").orderBy("at", "id")
    r = renewals.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(w) > interval, F.lit(True)).cast("int"))
    r = r.withColumn("k", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return r.groupBy("owner", "k").agg(F.min("at").alias("start_at"), F.max("at").alias("last_at"), F.count("*").alias("n")).drop("k")


def _lease(interval: int, start: int):
    """State of a chunk's leases: when the read and the write lease expire."""
    until: dict[str, int] = {}

    def step(r):
        if r is None:
            return []
        held = {k for k, t in until.items() if r.at <= t}
        error = None
        if r.kind == "renew":
            kind = "write" if "write" in until else "read"
            error = "ENOENT" if kind not in until else None if kind in held else "ELEASEEXPIRED"
            if error == "ELEASEEXPIRED":
                del until[kind]
        else:
            kind = r.kind
            busy = "write" in held or (kind == "write" and "read" in held)
            error = "EBUSY" if busy or r.at < start + interval else None
        if not error:
            until[kind] = r.at + interval
        return [(r.chunk_id, r.id, error)]

    return step


def lease_outcomes(requests: DataFrame, interval: int, start: int) -> DataFrame:
    """``(chunk_id, id, error)`` of ``requests(chunk_id, id, order, at, kind)``, in ``order``; no error is null.

    ``kind`` is ``read``, ``write`` or ``renew``. A lease is valid up to and including its expiry.
    Nothing is granted in the first ``interval`` after ``start``. A write lease that is valid
    keeps all others off, valid read leases keep a write lease off. A renewal is for the write
    lease, else the read lease, and only while it is valid; one that comes later ends it.
    """
    return fold_sorted(requests.select("chunk_id", "id", "order", "at", "kind"), "chunk_id", "order", lambda: _lease(interval, start), "chunk_id long, id long, error string")


def lease_valid_at(islands: DataFrame, at: int, interval: int) -> DataFrame:
    """Owners whose lease is valid at ``at``: valid up to and including its expiry."""
    return islands.where((F.col("start_at") <= at) & (F.lit(at) <= F.col("last_at") + interval)).select("owner", (F.col("last_at") + interval).alias("expires_at"))


def last_heard(beats: DataFrame, now: int, dead_after: int) -> DataFrame:
    b = beats.groupBy("server").agg(F.max("at").alias("last_at"), F.count("*").alias("n_beats"))
    return b.select("server", "last_at", "n_beats", (F.lit(now) - F.col("last_at") > dead_after).alias("dead"))


def reservation_decay(requests: DataFrame, now: int, half: int, most: int) -> DataFrame:
    """``(target, reserved)``: grants of a quarter of the request (at most ``most``), halved every ``half``."""
    grant = F.least(F.lit(float(most)), F.greatest(F.col("size"), F.lit(1.0)) * 0.25)
    halvings = F.floor((F.lit(now) - F.col("at")) / F.lit(half))
    return requests.groupBy("target").agg(F.round(F.sum(grant * F.pow(F.lit(0.5), halvings)), 6).alias("reserved"))
