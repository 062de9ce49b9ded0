"""Keyed records: filters, duplicates, sort, index, range plans, groups and checks.

Records have ``part, attempt, seq, key`` and payload columns. Keys compare as unsigned bytes and
a prefix comes first, which is the order of string and binary columns. The order of records with
equal keys is not defined anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import key_successor
from tidemark.session import materialise


def validate_partitions(records: DataFrame, n: int) -> DataFrame:
    """Records as they are; a partition outside 0..n-1 fails the query."""
    bad = F.raise_error(F.format_string("partition %s out of range", F.col("part").cast("string"))).cast("int")
    return records.withColumn("part", F.when(F.col("part").between(0, n - 1), F.col("part")).otherwise(bad))


def drop_dead_attempts(records: DataFrame, dead: DataFrame) -> DataFrame:
    """Without records of the attempts in ``dead(attempt)``."""
    return records.join(dead.select("attempt").distinct(), "attempt", "left_anti")


def latest_attempt(records: DataFrame) -> DataFrame:
    """Attempt n of a mapper makes its attempts 0..n-1 invalid."""
    last = records.groupBy("mapper").agg(F.max("retry").alias("_last"))
    return records.join(last, "mapper").where("retry = _last").drop("_last")


def drop_duplicate_records(records: DataFrame) -> DataFrame:
    """One record for each (partition, attempt, sequence number)."""
    return records.dropDuplicates(["part", "attempt", "seq"])


def key_range(records: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Records with low <= key < high; an open end is null. The scan gets the filter."""
    if low is not None:
        records = records.where(F.col("key") >= low)
    return records if high is None else records.where(F.col("key") < high)


def sorted_runs(records: DataFrame, n: int) -> DataFrame:
    """One partition's records together, sorted by key: what a sink writes as sorted runs."""
    return records.repartition(n, "part").sortWithinPartitions("part", "key")


def group_stream(records: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "key") -> DataFrame:
    """``fn`` once for each key with its records, as a reducer reads the merged stream."""
    return records.groupBy(key).applyInPandas(fn, schema)


def group_totals(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum("qty"), 2).alias("sum_qty"))


def group_size_histogram(records: DataFrame) -> DataFrame:
    """How many keys have how many records."""
    sizes = records.groupBy("part", "key").agg(F.count("*").alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count("*").alias("n_groups"))


def sparse_index(records: DataFrame, every: int) -> DataFrame:
    """Index entries ``(part, run, rec_no, offset, key, rec_len)`` of sorted runs.

    A run is the records of one attempt in a partition. Entries stand at each ``every``-th record
    and at the last.
    """
    w = W.partitionBy("part", "attempt").orderBy("key", "seq")
    r = records.withColumn("rec_no", F.row_number().over(w).cast("long") - 1)
    r = r.withColumn("offset", F.sum("rec_len").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("rec_len"))
    r = r.withColumn("_last", F.lead("seq").over(w).isNull())
    return r.where((F.col("rec_no") % every == 0) | F.col("_last")).select("part", "attempt", "rec_no", "offset", "key", "rec_len")


def overflow_index(records: DataFrame, block: int) -> DataFrame:
    """Index entries where blocks of at most ``block`` bytes start: a record that would overflow opens one.

    The reset makes the sum sequential: runs are sorted side by side, and a task reads them batch
    by batch with the place in one run in hand.
    """
    schema = "part int, attempt long, rec_no long, offset long, key string, rec_len long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.part, r.attempt) != at:
                    out += [last[1]] if last and not last[0] else []  # the last record of a run has an entry too
                    at, held, no, offset = (r.part, r.attempt), block + 1, 0, 0
                starts = held + r.rec_len > block
                held = r.rec_len if starts else held + r.rec_len
                last = (starts, (r.part, r.attempt, no, offset, r.key, r.rec_len))
                out += [last[1]] if starts else []
                no, offset = no + 1, offset + r.rec_len
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in schema.split(", ")])
        if last and not last[0]:
            yield pd.DataFrame([last[1]], columns=[x.split(" ")[0] for x in schema.split(", ")])

    rows = records.select("part", "attempt", "key", "seq", "rec_len")
    return rows.repartition("part", "attempt").sortWithinPartitions("part", "attempt", "key", "seq").mapInPandas(run, schema)


def index_range(index: DataFrame, low: str, high: str) -> DataFrame:
    """For each run, where to start and stop reading for [low, high), and the estimated records.

    Reading starts at the last entry strictly below ``low`` (else the first) and stops at the
    first entry at or above ``high`` (else the last).
    """
    below, above = F.col("key") < low, F.col("key") >= high
    g = index.groupBy("part", "attempt").agg(
        F.coalesce(F.max(F.when(below, F.col("rec_no"))), F.min("rec_no")).alias("start_rec"),
        F.coalesce(F.min(F.when(above, F.col("rec_no"))), F.max("rec_no")).alias("end_rec"),
    )
    return g.withColumn("estimate", F.greatest(F.col("end_rec") - F.col("start_rec") + 1, F.lit(0).cast("long")))


def positions(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` plus ``pos``, their place from 0 in each ``by`` in ``order``; ties in any order.

    No task holds a whole ``by``: rows are sorted by ranges (ties dealt by a hash, so that a hot
    key is split), and the sizes of the ranges before one are added to the places inside it.
    """
    keys = [by, *order, F.xxhash64(*rows.columns)]
    r = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    r = materialise(r.withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sorted")
    s = r.groupBy(by, "_slice").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = W.partitionBy(by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    s = s.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    return r.join(s, [by, "_slice"]).withColumn("pos", F.col("_at") + F.col("_before")).select(*rows.columns, "pos")


def sampled_index(index: DataFrame, whole_runs: int = 50, every: int = 8) -> DataFrame:
    """The index with only the first and last entry of most runs beyond the first ``whole_runs``.

    Runs of a file are numbered by attempt from 0; beyond, each ``every``-th stays whole. First and
    last entries always stay, so the range of keys does not shrink.
    """
    runs = index.groupBy("part", "attempt").agg(F.min("rec_no").alias("_low"), F.max("rec_no").alias("_high"))
    runs = runs.withColumn("_run", F.row_number().over(W.partitionBy("part").orderBy("attempt")) - 1)  # a row a run
    whole = (F.col("_run") < whole_runs) | (F.col("_run") % every == 0)
    j = index.join(runs, ["part", "attempt"]).where(whole | F.col("rec_no").isin(F.col("_low"), F.col("_high")))
    return j.select(*index.columns)


def range_plan(index: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """Half-open key ranges ``(part, task, low, high)`` of about ``limit`` bytes.

    ``sizes(part, bytes)``. The keys of the index are cut into equal numbers of distinct keys; the
    last range ends at the successor of the last key. Files without bytes or keys are left out.
    """
    keys = index.select("part", F.col("key").cast("binary").alias("key")).distinct()
    last = keys.groupBy("part").agg(F.max("key").alias("key")).select("part", key_successor("key").alias("key"))
    keys = keys.unionByName(last)
    keys = positions(keys, "part", "key").withColumnRenamed("pos", "i")
    cut = keys.join(keys.groupBy("part").agg(F.count("*").alias("n")).join(sizes.where("bytes > 0"), "part"), "part").withColumn("tasks", F.ceil(F.col("bytes") / F.lit(limit)))
    cut = cut.withColumn("split", F.expr("n div tasks")).withColumn("single", (F.col("split") == 0) | (F.col("n") == F.col("tasks")))
    cut = cut.withColumn("tasks", F.when(F.col("single"), F.col("n") - 1).otherwise(F.col("tasks"))).withColumn("split", F.when(F.col("single"), 1).otherwise(F.col("split")))
    # each boundary opens its task; the last task runs to the end
    cut = cut.where(((F.col("i") % F.col("split") == 0) & (F.expr("i div split") < F.col("tasks"))) | (F.col("i") == F.col("n") - 1))
    cut = cut.withColumn("task", F.expr("least(i div split, tasks)").cast("int")).withColumn("high", F.lead("key").over(W.partitionBy("part").orderBy("key")))  # a row a task
    cut = cut.where(F.col("high").isNotNull())
    return cut.select("part", "task", F.hex("key").alias("low"), F.hex("high").alias("high"))


#: Starts in a node of the tree by which records find their range: a power of two.
FANOUT = 64


def _last_start(starts: Column, rows: DataFrame, low: Callable[[Column], Column], fanout: int) -> DataFrame:
    """``rows`` plus ``_at``, the place of the last of ``starts`` at or before the key, by halving."""
    rows, step = rows.withColumn("_at", F.lit(0)), fanout // 2
    while step:
        further = F.col("_at") + step
        rows = rows.withColumn("_at", F.when(low(F.get(starts, further)) <= F.col("key").cast("binary"), further).otherwise(F.col("_at")))
        step //= 2
    return rows


def assign_ranges(records: DataFrame, plan: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records with the task of their range: the range that starts last at or before the key.

    The starts of a partition are the leaves of a tree of ``fanout`` starts a node. A level is a
    table with a row a node, joined on the partition and the node that the level above gives; in a
    node the start is found by halving. So no record carries more than a node, a lookup takes
    steps like the logarithm of the number of tasks, and records are moved only where a level is
    too large to broadcast. Levels are written first, so joins know their exact size.
    """
    numbered = plan.select("part", F.unhex("low").alias("low"), "task")
    numbered = numbered.withColumn("_node", F.row_number().over(W.partitionBy("part").orderBy("low")).cast("long") - 1)  # a row a task
    node = F.expr(f"_node div {fanout}L")
    level = numbered.groupBy("part", node.alias("_node")).agg(F.min("low").alias("low"), F.array_sort(F.collect_list(F.struct("low", "task"))).alias("_starts"))
    levels = [materialise(level, "plan")]
    while (levels[-1].agg(F.max("_node")).first()[0] or 0) > 0:
        level = levels[-1].groupBy("part", node.alias("_node")).agg(F.min("low").alias("low"), F.array_sort(F.collect_list("low")).alias("_starts"))
        levels.append(materialise(level, "plan"))
    root = levels[-1].select("part", F.col("low").alias("_first"))
    r = records.join(root, "part").where(F.col("_first") <= F.col("key").cast("binary")).drop("_first").withColumn("_node", F.lit(0).cast("long"))
    for level in levels[:0:-1]:
        r = _last_start(F.col("_starts"), r.join(level.drop("low"), ["part", "_node"]), lambda x: x, fanout)
        r = r.withColumn("_node", F.col("_node") * fanout + F.col("_at")).drop("_starts", "_at")
    r = _last_start(F.col("_starts"), r.join(levels[0].drop("low"), ["part", "_node"]), lambda x: x.low, fanout)
    return r.select(*records.columns, F.get("_starts", F.col("_at")).task.alias("task"))


def byte_splits(sizes: DataFrame, limit: int) -> DataFrame:
    """Byte ranges ``(part, task, low, high)`` of at most ``limit`` bytes each."""
    n = F.ceil(F.col("bytes") / F.lit(limit)).cast("int")
    r = sizes.where("bytes > 0").withColumn("task", F.explode(F.sequence(F.lit(0), n - 1)))
    return r.select("part", "task", (F.col("task").cast("long") * limit).alias("low"), F.least((F.col("task").cast("long") + 1) * limit, "bytes").alias("high"))


def order_violations(records: DataFrame, order: Column, *by: str) -> DataFrame:
    """Number of records whose key is below the one before them in ``order``."""
    prev = F.lag("key").over(W.partitionBy(*by).orderBy(order))
    return records.withColumn("_prev", prev).agg(F.count("*").alias("n_records"), F.count_if(F.col("_prev") > F.col("key")).alias("n_violations"))


def compare_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions at which two sorted key streams differ: ``(part, pos, key_a, key_b)``."""

    def numbered(d, name):
        n = positions(d.select("part", "key", F.monotonically_increasing_id().alias("_row")), "part", "key")
        return n.select("part", F.col("key").alias(name), (F.col("pos") + 1).alias("pos"))

    return numbered(a, "key_a").join(numbered(b, "key_b"), ["part", "pos"], "full_outer").where("NOT (key_a <=> key_b)").select("part", "pos", "key_a", "key_b")


def task_statistics(records: DataFrame) -> DataFrame:
    return records.groupBy("attempt").agg(F.count("*").alias("n_records"), F.sum("rec_len").alias("n_bytes"))


def reconcile(expected: DataFrame, records: DataFrame) -> DataFrame:
    """``(part, expected, actual, difference)``; ``expected(part, expected)``."""
    actual = records.groupBy("part").agg(F.count("*").alias("actual"))
    j = expected.join(actual, "part", "full_outer")
    j = j.select("part", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return j.withColumn("difference", F.col("actual") - F.col("expected"))


def split_range_at(plan: DataFrame, part: int, task: int, key: Column) -> DataFrame:
    """A preempted task ends at ``key``; the rest of its range becomes a new last task of the file."""
    last = W.partitionBy("part")
    p = plan.withColumn("_new", F.max("task").over(last) + 1)
    hit = (F.col("part") == part) & (F.col("task") == task) & (key > F.col("low")) & (key < F.col("high"))
    kept = p.withColumn("high", F.when(hit, key).otherwise(F.col("high")))
    rest = p.where(hit).withColumn("low", key).withColumn("task", F.col("_new"))
    return kept.unionByName(rest).drop("_new")


def chunk_lineage(appended: DataFrame) -> DataFrame:
    """``(chunk_id, mappers)`` of ``appended(chunk_id, mapper)``: which mappers wrote to a chunk."""
    return appended.groupBy("chunk_id").agg(F.array_sort(F.collect_set("mapper")).alias("mappers"))


def mappers_to_rerun(appended: DataFrame, lost: DataFrame) -> DataFrame:
    """Distinct mappers of lost chunks."""
    return appended.join(lost.select("chunk_id").distinct(), "chunk_id", "left_semi").select("mapper").distinct()


def pack_into_chunks(records: DataFrame, chunk: int) -> DataFrame:
    """Offsets for appended records so that none crosses a chunk boundary, in order of ``seq``.

    Runs are read as in ``overflow_index``: the state is the place in one run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, end = None, 0
        for pdf in batches:
            offsets = []
            for part, attempt, n in zip(pdf["part"], pdf["attempt"], pdf["rec_len"], strict=True):
                if (part, attempt) != at:
                    at, end = (part, attempt), 0
                if end % chunk + n > chunk:
                    end += chunk - end % chunk
                offsets.append(end)
                end += n
            yield pdf.assign(offset=offsets)

    rows = records.select("part", "attempt", "seq", "rec_len")
    return rows.repartition("part", "attempt").sortWithinPartitions("part", "attempt", "seq").mapInPandas(run, "part int, attempt long, seq long, rec_len long, offset long")
