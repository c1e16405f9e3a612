"""Windows that end at as_of: rows after it never count."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from filinglens.operators import screener, signals
from filinglens.plans import read_api, stats

DAY = datetime(2024, 5, 10)
#: Days from as_of of the rows of every table: too early, inside, at the end, after it.
OFFSETS = (-400, -3, 0, 2, 30)
INSIDE = {1, 2}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, DAY + timedelta(days=d)) for i, d in enumerate(OFFSETS)]
    trades = spark.createDataFrame(
        [(i, f"m{i}", f"n{i}", f"T{i}", "purchase", t.date(), t.date(), 1.0, 2.0, t) for i, t in rows],
        "trade_id long, member_bioguide_id string, member_name string, ticker string, transaction_type string, "
        "transaction_date date, disclosure_date date, amount_range_low double, amount_range_high double, created_at timestamp")
    predictions = spark.createDataFrame(
        [(k * 10 + i, i, kind, label, 0.9, 0.5, t) for i, t in rows
         for k, (kind, label) in enumerate((("profitability", "profitable"), ("anomaly", "anomalous")))],
        "prediction_id long, trade_id long, prediction_type string, predicted_label string, confidence double, "
        "predicted_value double, created_at timestamp")
    media = spark.createDataFrame(
        [(i, [f"m{j}" for j in range(5)], "news", t.date()) for i, t in rows],
        "media_id long, member_bioguide_ids array<string>, source_type string, published_date date")
    mood = spark.createDataFrame(
        [(i, -0.9 if i in INSIDE else 5.0, "neg") for i, _ in rows], "media_id long, sentiment_score double, sentiment_label string")
    old = spark.createDataFrame(
        [("trade_follow", f"m{i}", f"T{i}", DAY + timedelta(days=3)) for i, _ in rows],
        "signal_type string, member_bioguide_id string, ticker string, created_at timestamp")
    return trades, predictions, media, mood, old, F.lit(str(DAY)).cast("timestamp")


def _tickers(df):
    return {r["ticker"] for r in df.collect()}


def test_generators(frames):
    trades, predictions, media, mood, old, as_of = frames
    want = {f"T{i}" for i in INSIDE}
    assert _tickers(signals.trade_follow(predictions, trades, old, as_of)) == want  # later signals suppress nothing
    assert _tickers(signals.anomaly_alerts(predictions, trades, old, as_of)) == want
    assert _tickers(signals.sentiment_divergence(trades, media, mood, old, as_of)) == want
    clusters = signals.insider_clusters(trades.withColumn("ticker", F.lit("X")), old, as_of, least=2)
    assert [r["evidence"]["cluster_size"] for r in clusters.collect()] == [2]


def test_screener(spark, frames):
    trades, predictions, *_, as_of = frames
    assert _tickers(screener.ml_confidence(predictions, trades, as_of)) == {"T1", "T2"}
    live = spark.createDataFrame(
        [(True, "bullish", 0.9, f"T{i}", DAY + timedelta(days=d), DAY + timedelta(days=90)) for i, d in enumerate(OFFSETS)],
        "is_active boolean, direction string, strength double, ticker string, created_at timestamp, expires_at timestamp")
    assert _tickers(screener.live_bullish(live, as_of)) == {"T0", "T1", "T2"}


def test_figures(frames):
    trades, _, media, mood, *_ = frames
    day = date(2024, 5, 10)
    assert stats.trade_totals(trades, day).first()["recent_trades_7d"] == 2
    assert stats.freshness(trades, day)["recent_trades_7d",].first()[0] == 2
    assert {r["n"] for r in stats.media_stats(media, mood, day).where("figure = 'content_last_7_days'").collect()} == {2}
    assert stats.sentiment_timeline(media, mood, "m0", 30, day).count() == 2


def test_pages_keep_order_and_offset(spark):
    rows = spark.createDataFrame([(i,) for i in (4, 1, 3, 0, 2)], "k int")
    assert [r["k"] for r in read_api.page(rows, ["k"], None, 2).collect()] == [2, 3, 4]
    assert [r["k"] for r in read_api.page(rows, [F.desc("k")], 2, 1).collect()] == [3, 2]


def test_functions_travel_by_value(tmp_path):
    """Workers without the package can run its Python functions."""
    import os
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from filinglens.session import local_session\nfrom filinglens.plans import catalog\n"
        "print('rows', catalog.QUERIES['e04_match_fuzzy'](local_session('away', '2'), '/root/testdata/sf0.001').count())\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
