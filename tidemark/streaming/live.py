"""Structured Streaming operators with state: duplicates, slow nodes, leases.

Each is a transformation of a streaming DataFrame; ``drain`` runs one over all input there is and
returns what it has written, which is how the batch tests and queries use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.session import scratch_dir


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet folder or file as a stream; the file limit is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drop_duplicates(stream: DataFrame, event_time: str, delay: str, *by: str) -> DataFrame:
    """First record of each key; state goes when the watermark has passed."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(by))


def slow_nodes(samples: DataFrame, open_rounds: int = 64) -> DataFrame:
    """Average a target after each batch of ``samples(target, round, timetaken)``, in any order.

    Rows ``(target, version, base, closed, rounds, sums, counts)``: the average when round ``base``
    began, and the samples of the rounds from there. The last ``open_rounds`` rounds up to a
    target's newest stay open for late samples; earlier ones are closed into one number, and
    samples for them are ignored. ``version`` counts a target's batches.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, base, closed, rounds, sums, counts = state.get if state.exists else (0, 0, 0.0, [], [], [])
        held = dict(zip(rounds, zip(sums, counts, strict=True), strict=True))
        for pdf in frames:
            pdf = pdf[(pdf["timetaken"] >= 1e-6) & (pdf["round"] >= base)]
            for r, values in pdf.groupby("round")["timetaken"]:
                total, n = held.get(int(r), (0.0, 0))
                held[int(r)] = (total + float(values.sum()), n + len(values))
        for r in range(base, max(held, default=-1) - open_rounds + 1):
            total, n = held.pop(r, (0.0, 0))
            closed, base = closed / 2 + (total / n if n else 0.0), r + 1
        rounds = sorted(held)
        value = (version + 1, base, closed, rounds, [held[r][0] for r in rounds], [held[r][1] for r in rounds])
        state.update(value)
        yield pd.DataFrame([(key[0], *value)], columns=["target", "version", "base", "closed", "rounds", "sums", "counts"])

    kind = "version long, base long, closed double, rounds array<long>, sums array<double>, counts array<long>"
    return samples.groupBy("target").applyInPandasWithState(fold, f"target long, {kind}", kind, "update", GroupStateTimeout.NoTimeout)


def ewma_at(averages: DataFrame, rounds: int, limit: float = 10.0) -> DataFrame:
    """``(target, ewma, slow)`` after ``rounds`` rounds from the last row of each target."""
    last = averages.groupBy("target").agg(F.max_by(F.struct("base", "closed", "rounds", "sums", "counts"), "version").alias("x")).select("target", "x.*")
    half = lambda r: F.pow(F.lit(0.5), F.lit(rounds - 1) - r)
    parts = F.transform("rounds", lambda r, i: F.get("sums", i) / F.get("counts", i) * half(r))
    e = F.aggregate(parts, F.col("closed") * half(F.col("base") - 1), lambda a, x: a + x)
    return last.where((F.size("rounds") > 0) | (F.col("base") > 0)).select("target", F.round(e, 6).alias("ewma"), (e > limit).alias("slow"))


def leases(renewals: DataFrame, interval: int, keep: int | None = None) -> DataFrame:
    """Leases ``(owner, version, start_at, last_at, n, ended)`` of ``renewals(owner, at)``, in any order.

    A renewal joins the leases that it is within ``interval`` of, which may make one of two. After
    each batch the leases that late renewals can still reach are emitted anew under a higher
    ``version``; those that ended over ``keep`` before the owner's newest renewal are emitted as
    ended, once, and leave the state. Without ``keep`` none ends.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, starts, lasts, counts = state.get if state.exists else (0, [], [], [])
        held = [*zip(starts, lasts, counts, strict=True), *((int(x), int(x), 1) for f in frames for x in f["at"])]
        merged: list[list[int]] = []
        for start, last, n in sorted(held):
            if merged and start - merged[-1][1] <= interval:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], last), merged[-1][2] + n
            else:
                merged.append([start, last, n])
        newest = max(x[1] for x in merged)
        over = [keep is not None and newest - x[1] > keep for x in merged]
        rest = [x for x, done in zip(merged, over, strict=True) if not done]
        state.update((version + 1, *([x[i] for x in rest] for i in range(3))))
        yield pd.DataFrame([(key[0], version + 1, *x, done) for x, done in zip(merged, over, strict=True)], columns=["owner", "version", "start_at", "last_at", "n", "ended"])

    kind = "version long, starts array<long>, lasts array<long>, counts array<long>"
    return renewals.groupBy("owner").applyInPandasWithState(fold, "owner long, version long, start_at long, last_at long, n long, ended boolean", kind, "update", GroupStateTimeout.NoTimeout)


def current_leases(rows: DataFrame) -> DataFrame:
    """All leases: those that ended, and of the others the owner's newest version."""
    newest = rows.groupBy("owner").agg(F.max("version").alias("_v"))
    return rows.join(newest, "owner").where("ended or version = _v").select("owner", "start_at", "last_at", "n")


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run ``stream`` over all input there is now; the rows it wrote, from the shared scratch folder."""
    spark = stream.sparkSession
    at = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")  # a batch that runs again replaces itself

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
