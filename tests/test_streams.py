"""Streams keep state per group, not per row."""

from datetime import datetime, timedelta

from filinglens.streaming import jobs

T0 = datetime(2024, 1, 1, 10)


def test_expiry_reports_what_is_due_and_keeps_state_by_hour(spark, tmp_path):
    due = [1, 2, 2, 59, 61, 300, 301, None]  # minutes; the last signal is created at 300
    rows = [(i, True, T0 + timedelta(minutes=300 if i == 7 else 0), None if m is None else T0 + timedelta(minutes=m)) for i, m in enumerate(due)]
    rows += [rows[0], (8, False, T0, T0), (9, True, T0 + timedelta(minutes=300), T0 + timedelta(days=1)), (0, True, T0, T0 + timedelta(minutes=30))]
    signals = spark.createDataFrame(rows, "signal_id long, is_active boolean, created_at timestamp, expires_at timestamp")
    signals.coalesce(1).write.parquet(f"{tmp_path}/s")
    stream = jobs.stream_expiry(jobs.read_files(spark, f"{tmp_path}/s", signals.schema))
    ms = lambda m: int((T0 - datetime(1970, 1, 1)).total_seconds() + m * 60) * 1000
    assert sorted(map(tuple, jobs.drain(stream, "expiry").collect())) == sorted(
        [(i, ms(m)) for i, m in enumerate(due[:6])] + [(0, ms(30))])
    assert "hour" in stream._jdf.queryExecution().analyzed().toString()


def test_clusters_count_members_from_daily_sets(spark, tmp_path):
    rows = [("T", "buy", f"m{i}", (T0 + timedelta(days=d)).date()) for i in range(40) for d in {i % 3, 5}] + [
        ("T", "buy", "m1", T0.date()), (None, "buy", "m2", T0.date()), ("U", "buy", "m2", (T0 + timedelta(days=90)).date())]
    trades = spark.createDataFrame(rows, "ticker string, transaction_type string, member_bioguide_id string, transaction_date date")
    trades.coalesce(1).write.parquet(f"{tmp_path}/t")
    stream = jobs.stream_clusters(jobs.read_files(spark, f"{tmp_path}/t", trades.schema))
    got = {r.window_start: (r.members, r.trades) for r in jobs.drain(stream, "clusters").collect()}
    want = {}
    for s in range(-6, 6):
        inside = [(m, d) for t, _, m, d in rows if t == "T" and 0 <= (d - T0.date()).days - s < 7]
        if len({m for m, _ in inside}) >= 3:
            want[datetime(2024, 1, 1) + timedelta(days=s)] = (len({m for m, _ in inside}), len(inside))
    assert got == want and "collect_set" in stream._jdf.queryExecution().analyzed().toString()
