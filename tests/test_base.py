import os

import duckdb
import pytest

import __spark_entry__ as e
from sievework.plans import base


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_entry(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(base.queries()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        if t.endswith(".parquet"):
            con.sql(f"create view {t[:-8]} as select * from read_parquet('{sf_dir}/{t}')")
    rel = con.sql(base.oracle_sql()[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert rows_of(base.queries()[name](spark, sf_dir)) == sorted(tuple(r[i] for i in order) for r in rel.fetchall())


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo", "Pacific/Apia"])
def test_event_days_in_any_zone(spark, sf_dir, zone):
    own = spark.conf.get("spark.sql.session.timeZone")
    want = rows_of(base.queries()["stream_event_days"](spark, sf_dir))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert rows_of(base.queries()["stream_event_days"](spark, sf_dir)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", own)
