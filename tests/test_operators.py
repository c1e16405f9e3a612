"""Edge cases on small frames."""

import itertools
import random
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from filinglens import constants as K
from filinglens.functions import text
from filinglens.operators import asof, dayrange, graph, history, indicators, merge, metrics, resolve, signals
from filinglens.learn import folds
from filinglens.learn.anomaly import Forest, fit_anomaly, score_anomaly

D = date(2020, 1, 10)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_asof_and_forward_edges(spark):
    prices = spark.createDataFrame([("A", D + timedelta(days=i), 10.0 + i) for i in (0, 1, 5)], "ticker string, date date, adj_close double")
    trades = spark.createDataFrame(
        [(1, "A", D - timedelta(days=1)), (2, "A", D), (3, "A", D + timedelta(days=3)), (4, "A", D + timedelta(days=9)), (5, None, D)],
        "trade_id long, ticker string, transaction_date date")
    assert rows(asof.asof_price(trades, prices), "trade_id", "base_price") == [(1, None), (2, 10.0), (3, 11.0), (4, 15.0), (5, None)]
    assert rows(asof.asof_price(trades, prices, strict=True), "trade_id", "base_price")[1] == (2, None)
    assert rows(asof.nth_price_after(trades, prices, 1), "trade_id", "price_future") == [(1, 11.0), (2, 15.0), (3, None), (4, None), (5, None)]


def test_hearing_window_bounds(spark):
    offsets = [-31, -30, -7, -3, -1, 0, 1, 7, 30, 31]
    hearings = spark.createDataFrame([(i, "c", D + timedelta(days=o)) for i, o in enumerate(offsets)], "hearing_id long, committee_code string, hearing_date date")
    seats = spark.createDataFrame([("m", "c", 116), ("m", "c", 115)], "member_bioguide_id string, committee_code string, congress_number int")
    trades = spark.createDataFrame([(1, "m", D), (2, None, D)], "trade_id long, member_bioguide_id string, transaction_date date")
    got = dayrange.hearing_proximity(trades, seats, hearings).collect()
    assert [r.asDict() for r in got] == [
        {"trade_id": 1, "hearing_count": 8, "before_7d": 3, "after_7d": 2, "before_3d": 2, "min_hearing_dist": 0}]


@pytest.mark.parametrize("n", [1, 2, 25, 26, 259, 260, 300, 700])
def test_ema_matches_recurrence(spark, n):
    values = [100 + (i * 37 % 11) + i / 7 for i in range(n)]
    prices = spark.createDataFrame([("A", D + timedelta(days=i), v, 1) for i, v in enumerate(values)], "ticker string, date date, adj_close double, volume long").withColumn("close", F.col("adj_close"))
    got = indicators.with_ema(indicators.prepare(prices), 12).orderBy("date").collect()[-1]["ema_12"]
    window = values[-260:]
    expected = window[0]
    for v in window[1:]:
        expected = v * 2 / 13 + expected * 11 / 13
    assert got == pytest.approx(expected, rel=1e-9)


def test_fuzzy_matching_equals_brute_force(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "alpine", "betas", "ab", "q"]
    known = [" ".join(p) for p in itertools.permutations(words[:6], 2)] + ["ab", "q", "gamme rays", "xyzzy"]
    asked = ["alpha betta", "betas alpine", "delta omga", "omega gama", "abc", "q", "gamma ray", "nothing like it", "delta"]
    lookup = spark.createDataFrame([(k, f"T{i}") for i, k in enumerate(known)], "normalised string, ticker string")
    names = spark.createDataFrame([(a,) for a in asked], "name string")
    got = {r["name"]: r["confidence"] for r in resolve.match_fuzzy(names, lookup).collect()}

    def lcs(a, b):
        table = [0] * (len(b) + 1)
        for ch in a:
            row = table[:]
            for j, other in enumerate(b):
                table[j + 1] = row[j] + 1 if ch == other else max(row[j + 1], table[j])
        return table[-1]

    def score(a, b):
        a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        return int(200 * lcs(a, b) / (len(a) + len(b)) + 0.5) / 100
    expected = {a: max(score(a, k) for k in known) for a in asked}
    assert got == {a: s for a, s in expected.items() if s >= K.FUZZY_MIN}


def test_common_subsequences_of_all_lengths():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcé 漢\U0001f600", k=rng.choice([1, 2, 5, 31, 62, 63, 64, 90]))) for _ in range(400)] + ["", "a", "z" * 63]
    left, right = texts, rng.sample(texts, len(texts))
    got = resolve._similarity(pd.Series(left), pd.Series(right)).tolist()
    assert got == [int(100 * resolve.indel_ratio(a, b) + 0.5) / 100 for a, b in zip(left, right)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for ch in a:
            old = row[:]
            for j, other in enumerate(b):
                row[j + 1] = old[j] + 1 if ch == other else max(old[j + 1], row[j])
        return row[-1]
    short = [(a, b) for a, b in zip(left, right) if 0 < len(a) <= resolve.WORD_LETTERS][:60]
    assert resolve.common_letters(*map(list, zip(*short))).tolist() == [lcs(a, b) for a, b in short]


def test_override_before_exact_before_fuzzy(spark):
    lookup = spark.createDataFrame([("acme widgets", "ACW"), ("apple", "X")], "normalised string, ticker string")
    names = spark.createDataFrame([("Apple Inc.",), ("Acme Widgets LLC",), ("Acme Widgetts",), ("zzz",)], "name string")
    got = {r["name"]: (r["ticker"], r["method"]) for r in resolve.resolve_names(names, lookup).collect()}
    assert got == {"Apple Inc.": ("AAPL", "manual"), "Acme Widgets LLC": ("ACW", "exact"), "Acme Widgetts": ("ACW", "fuzzy")}


def test_null_keys_never_collide(spark):
    schema = "id long, a string, b double"
    target = spark.createDataFrame([(1, "x", 1.0), (2, None, 1.0)], schema)
    staged = spark.createDataFrame([(3, "x", 1.0), (4, None, 1.0), (5, "y", 1.0), (6, "y", 1.0), (7, "x", None)], schema)
    assert rows(merge.insert_new(target, staged, ["a", "b"], ["id"]), "id") == [(1,), (2,), (4,), (5,), (7,)]


def test_upsert_limits_columns_and_takes_last(spark):
    target = spark.createDataFrame([("k", "old", "keep")], "id string, a string, b string")
    staged = spark.createDataFrame([("k", "one", "no", 1), ("k", None, "no", 2), ("n", "new", "yes", 1)], "id string, a string, b string, seq int")
    got = rows(merge.upsert(target, staged, ["id"], ["seq"], ["a"]))
    assert [tuple(r) for r in got] == [("k", None, "keep"), ("n", "new", "yes")]


def test_member_history_needs_three_outcomes(spark):
    days = [D + timedelta(days=i) for i in range(40)]
    prices = spark.createDataFrame([("A", d, 10.0 + i) for i, d in enumerate(days)], "ticker string, date date, adj_close double")
    trades = spark.createDataFrame([(i, "m", "A", D, "purchase") for i in range(5)], "trade_id long, member_bioguide_id string, ticker string, transaction_date date, transaction_type string")
    got = rows(history.member_history(trades, prices, 4), "trade_id", "member_win_rate", "member_trade_count")
    assert got == [(0, 0.5, 0.0), (1, 0.5, 0.0), (2, 0.5, 0.0), (3, 1.0, 3.0), (4, 1.0, 4.0)]


def test_missing_member_counts_as_one(spark):
    trades = spark.createDataFrame([(1, "A", D, "m", "purchase"), (2, "A", D, None, "purchase"), (3, "A", D, None, "sale"), (4, "A", D + timedelta(days=8), "n", "purchase")],
                                   "trade_id long, ticker string, transaction_date date, member_bioguide_id string, transaction_type string")
    assert rows(history.cross_member(trades)) == [(1, 1.0, 2.0, 1.0), (2, 1.0, 2.0, 1.0), (3, 1.0, 2.0, 0.0), (4, 0.0, 2.0, 0.0)]


def test_rate_limit_slides(spark):
    t0 = datetime(2024, 1, 1)
    sent = [(1, i, t0 + timedelta(minutes=i)) for i in range(11)] + [(1, 11, t0 + timedelta(minutes=60)), (1, 12, t0 + timedelta(minutes=60, seconds=1)), (1, 13, t0 + timedelta(hours=5))]
    df = spark.createDataFrame(sent, "config_id long, signal_id long, created_at timestamp")
    assert [r[0] for r in rows(signals.rate_limit(df), "signal_id")] == [*range(10), 11, 13]


def test_suppress_within_run_and_null_member(spark):
    as_of = F.lit("2024-01-10").cast("timestamp")
    schema = "signal_type string, ticker string, member_bioguide_id string, n int"
    found = spark.createDataFrame([("s", "A", None, 1), ("s", "A", None, 2), ("s", "A", "m", 3), ("s", "B", "m", 4)], schema)
    old = spark.createDataFrame([("s", "A", None, datetime(2024, 1, 9)), ("s", "B", "m", datetime(2024, 1, 1))], "signal_type string, ticker string, member_bioguide_id string, created_at timestamp")
    assert [r[0] for r in rows(signals.suppress(found, old, ["ticker", "member_bioguide_id"], as_of, ["n"]), "n")] == [3, 4]


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y_true int, y_proba double")
    assert metrics.auc(df).first()[0] == pytest.approx(0.875)
    assert metrics.auc(df.filter("y_true = 1")).first()[0] == 0.5
    assert metrics.classifier_metrics(df.filter("false").withColumn("y_pred", F.lit(1))).first()["accuracy"] == 0


def test_month_folds_need_enough_months(spark):
    df = spark.createDataFrame([(i, date(2022, 1, 1) + timedelta(days=i)) for i in range(730)], "trade_id long, transaction_date date")
    got = folds.month_folds(df, 5).groupBy("fold").pivot("role", ["train", "test"]).agg(F.min("transaction_date"), F.max("transaction_date")).collect()
    assert got and all(r[2] < r[3] for r in got)
    assert folds.month_folds(df.limit(200), 5).count() == 0


def test_paths_tie_and_disconnected(spark):
    e = [("M", "1", "R", "X", "a"), ("M", "1", "R", "X", "b"), ("X", "a", "R", "C", "z"), ("X", "b", "R", "C", "z"), ("M", "2", "R", "X", "c")]
    edges = spark.createDataFrame(e, "src_type string, src string, rel string, dst_type string, dst string")
    assert [r["nodes"] for r in graph.shortest_paths(edges, "M:1", "C:z").collect()] == [["M:1", "X:a", "C:z"], ["M:1", "X:b", "C:z"]]
    assert graph.shortest_paths(edges, "M:2", "C:z").count() == 0


def test_isolation_forest_flags_outlier(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(300)] + [(999, 90.0, -80.0)], "trade_id long, a double, b double")
    forest = fit_anomaly(df, ["a", "b"], trees=30)
    top = score_anomaly(df, forest).orderBy(F.desc("anomaly_raw")).first()
    assert top["trade_id"] == 999 and top["anomalous"] and top["anomaly_score_scaled"] == pytest.approx(1.0)
    forest.write(spark, str(tmp_path / "f"))
    assert Forest.read(spark, str(tmp_path / "f")).threshold == forest.threshold


def test_text_functions(spark):
    one = spark.range(1).select(
        text.split_member_name(F.lit("Banks, Hon.. James E Hon")).alias("n"), text.session_number(F.lit("2025-03-01").cast("date")).alias("s"),
        text.title_case(F.lit("O'NEIL-SMITH ann")).alias("t"), text.parse_date(F.lit("1/2/99"), (text.ISO, text.US, text.US_SHORT)).alias("d"),
        text.rss_date(F.lit("Mon, 05 Feb 2024 23:00:00 -0500")).alias("r"), text.normalise_company(F.lit("The Acme Corporation, Inc.")).alias("c"),
        text.ticker_mentions(F.lit("CEO of $NVDA and AAPL, NVDA")).alias("m"), text.amount_bounds(F.lit("$15,001 - $50,000")).alias("b")).first()
    assert tuple(one["n"]) == ("Banks", "James E") and one["s"] == 119 and one["t"] == "O'Neil-Smith Ann"
    assert one["d"] == date(1999, 1, 2) and one["r"] == date(2024, 2, 5) and one["m"] == ["NVDA", "AAPL"]
    assert (float(one["b"]["low"]) + float(one["b"]["high"])) / 2 == 32500.5 and "acme" in one["c"]


def test_signal_score_caps(spark):
    df = spark.createDataFrame([("insider_cluster", 0.9, 1)], "signal_type string, confidence double, disclosure_lag_days int")
    got = signals.score_signals(df.withColumn("evidence", signals.evidence(cluster_size=F.lit(6), trade_id=F.lit(1)))).first()
    assert got["strength"] == 1.0 and got["confidence"] == 0.9
