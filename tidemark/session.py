"""Session and scratch-folder helpers shared by every operator."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that tasks can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{here.name}", "zip", here.parent, here.name))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only on one machine (master ``local``), where the session names none, a temporary folder is
    set: on a cluster executors could not see it, so there the setting must be made.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


_written: dict[str, list[str]] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, which cuts its lineage.

    A lost executor costs no recomputation beyond this point, and the reread table has exact
    size statistics for the planner. The shuffle files of the write go as soon as it is done: the
    table stands in for them. ``by`` names columns whose values get folders of their own, so that
    a filter on them reads no others. The table stays until ``discard`` or ``release``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame, part: str = "") -> None:
    """Delete a table that ``materialise`` returned and that nothing will read again, or one ``part`` (``column=value``) of it."""
    spark = df.sparkSession
    mine = _written.get(spark.sparkContext.applicationId, [])
    for file in df.inputFiles()[:1]:
        for path in [p for p in mine if f"/{p.rsplit('/', 1)[1]}/" in file]:
            _delete(spark, f"{path}/{part}" if part else path)
            if not part:
                mine.remove(path)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; call it when a query's rows are used."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
