"""Every registered query with a SQL twin gives the twin's rows."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lodewatch.operators import aggregate
from lodewatch.plans import catalog
from lodewatch.sources import views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return str(x) if isinstance(x, (datetime.date, datetime.datetime)) else x


def rows(found, columns):
    return sorted(str([plain(r[c]) for c in columns]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    want = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows([r.asDict(recursive=True) for r in got.collect()], columns) == rows([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


def test_rollup_estimates_are_close(spark, sf):
    e = views.flat_events(spark, sf).withColumn("score", F.lit(1.0))
    for r in aggregate.merge_rollup(aggregate.rollup_state(e), ["tenant_id", "category_name"]).collect():
        assert r["event_count"] >= r["unique_users"] > 0 and r["unique_src_ips"] > 0 and r["avg_score"] == 1.0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["category_name", "events", "mean_bytes"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
