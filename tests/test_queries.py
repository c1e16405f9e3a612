"""Registered queries against their SQL. FILINGLENS_ALL=1 runs every one."""

import os

import pytest

import oracle
from filinglens.plans import catalog

SF = os.environ.get("FILINGLENS_SF_DIR", "/root/testdata/sf0.001")
QUICK = [
    "flagship_profitability", "j01_asof_price", "j02_nth_price_after_21d", "j05_hearing_proximity", "j07_nearby_bills",
    "w06_macd", "w12_member_history", "w13_cross_member", "w14_member_velocity", "a08_leaderboard", "a09_signal_stats",
    "a21_auc", "m01_insert_new_trades", "e09_apply_tickers", "e11_match_members", "g08_suspicious_triangles", "n08_rate_limit",
    "n18_recommend", "s06_filing_text", "s16_lobbying", "l02_purged_folds", "t01_stream_filings",
]
NAMES = list(catalog.QUERIES) if os.environ.get("FILINGLENS_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    actual = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        assert oracle.differences(actual, con.execute(catalog.ORACLES[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
