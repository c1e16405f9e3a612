"""The wide steps of the frame: looked-up days are broadcast, long steps are compiled, pinned tables are columnar."""

from datetime import date

import pytest

from filinglens.operators import asof
from filinglens.plans import catalog_learning
from filinglens.plans.views import Tables

D = date(2020, 1, 10)


@pytest.fixture
def unhinted(spark):
    """Joins are broadcast where the code asks for it alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_days_are_broadcast_and_keyed_days_are_not(unhinted):
    rows = unhinted.createDataFrame([(1, "m", D), (2, "m", None), (2, "n", D), (3, None, D)], "trade_id long, m string, d date")
    days = unhinted.createDataFrame([("m", D, 7)], "m string, _day date, n int")
    plain = asof.join_days(rows, days.drop("m"), [], "d")
    assert "BroadcastHashJoin" in plain._jdf.queryExecution().executedPlan().toString()
    keyed = asof.join_days(rows, days, ["m"], "d")
    assert "BroadcastHashJoin" not in keyed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.trade_id, r.m or "", r.n) for r in plain.collect()) == [(1, "m", 7), (2, "m", None), (2, "n", 7), (3, "", 7)]


def test_no_step_is_longer_than_hotspot_compiles(spark):
    Tables(spark, "none")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_pinned_tables_are_read_by_column(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    t.__dict__.update(
        trades=spark.createDataFrame([(1, "A", D), (1, "A", D), (None, None, None)], "trade_id long, ticker string, transaction_date date"),
        prices=spark.createDataFrame([("A", D, 1.0)], "ticker string, date date, adj_close double"))
    pinned = catalog_learning._pinned(t)
    assert "ReadSchema: struct<ticker:string>" in pinned.trades.select("ticker")._jdf.queryExecution().executedPlan().toString()
    assert pinned.trades.count() == 3 and pinned.prices.count() == 1
