"""The scratch folder and what is kept in it."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark import session


def test_a_cluster_without_a_shared_folder_fails():
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_tables_go_when_discarded_or_released(spark):
    a, b = (session.materialise(spark.range(10).withColumn("k", F.col("id") % 2), "kept", ("k",)) for _ in range(2))
    assert a.columns == ["id", "k"] and a.where("k = 1").count() == b.where("k = 1").count() == 5
    session.discard(a)
    assert b.count() == 10
    session.release(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        b.select("id").collect()


def test_shuffle_files_go_with_the_write(spark):
    """A written table stands in for its shuffle; the setting is as before afterwards."""
    before = spark.conf.get(session._CLEANUP, None)
    t = session.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert spark.conf.get(session._CLEANUP, None) == before and t.count() == 7
    session.discard(t)
