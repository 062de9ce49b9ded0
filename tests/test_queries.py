"""Every query with a SQL equivalent gives the same rows as DuckDB."""

import duckdb
import pytest

from tidemark.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def plain(frame):
    cols = sorted(frame.columns)
    text = frame[cols].apply(lambda s: s.astype(object).where(s.notna(), None).map(lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)))
    return text.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = plain(catalogue.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(catalogue.SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
