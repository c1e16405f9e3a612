"""Steps of cross-validated training that read, order or send no more rows and columns than they need."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from filinglens.learn import anomaly, folds, models
from filinglens.operators.ordinal import day_starts, row_positions
from filinglens.session import durable


def _trades(spark, n=2400):
    rows = [((i * 7919) % n, date(2020, 1, 1) + timedelta(days=i // 4 if i % 9 else i // 40)) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, None)], "trade_id long, transaction_date date").repartition(5)


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_cut_rows_split_like_positions(spark, n):
    df = _trades(spark)
    exact, cut = folds.positioned(df), folds.cut_rows(df, n, durable)
    found = folds.purged_folds(exact, n)
    assert found and folds.purged_folds(cut, n) == found
    members = [{tuple(r) for r in folds.fold_rows(rows, found).select("fold", "role", "trade_id").collect()} for rows in (exact, cut)]
    assert members[0] == members[1]
    # a day that no bound splits is not ordered
    assert cut.select("_pos").distinct().count() < cut.count() == exact.count()


def test_positions_of_whole_days(spark):
    df = _trades(spark)
    some = F.col("transaction_date").between(date(2020, 2, 1), date(2020, 2, 9))
    whole = {tuple(r) for r in row_positions(df, "transaction_date", "trade_id").filter(some).select("trade_id", "_pos").collect()}
    days = day_starts(df, "transaction_date")
    part = row_positions(df.filter(some), "transaction_date", "trade_id", days)
    assert {tuple(r) for r in part.select("trade_id", "_pos").collect()} == whole
    # rows without a day come first and have no position
    assert row_positions(df, "transaction_date", "trade_id").agg(F.min("_pos"), F.count("*")).first() == (2, 2400)


def test_no_rows_no_folds(spark):
    rows = folds.cut_rows(_trades(spark).filter("trade_id < 0"), 3, durable)
    assert rows.count() == 0 and folds.purged_folds(rows, 3) == []


def _walked(forest, point):
    total = 0.0
    for nodes in forest.trees:
        at = 0
        while nodes[at, 0] >= 0:
            at = int(nodes[at, 2] if point[int(nodes[at, 0])] < nodes[at, 1] else nodes[at, 3])
        total += nodes[at, 4]
    return 2.0 ** (-total / len(forest.trees) / anomaly._path_length(forest.sample))


def test_forest_scores_as_its_trees_are_walked(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(500, 3)).round(1)
    trees = [np.array(anomaly.grow(points[rng.choice(500, 64, replace=False)], rng, 6)) for _ in range(8)]
    forest = anomaly.Forest(["a", "b", "c"], [*trees, np.array([[-1, 0.0, -1, -1, 2.5]])], 64, threshold=0.5, low=0.3, high=0.7)
    asked = np.vstack([points, [[t[0, 1]] * 3 for t in trees], [[np.inf, -np.inf, 0.0]]])
    assert np.allclose(forest.scores(asked), [_walked(forest, p) for p in asked], rtol=1e-12, atol=0)

    df = spark.createDataFrame([(i, "x", *map(float, p)) for i, p in enumerate(points)], "id long, other string, a double, b double, c double")
    scored = anomaly.score_anomaly(df, forest)
    for r in scored.collect():
        raw = _walked(forest, [r["a"], r["b"], r["c"]])
        assert r["anomaly_raw"] == pytest.approx(raw, rel=1e-12) and r["anomalous"] == (r["anomaly_raw"] > 0.5)
        assert r["anomaly_score_scaled"] == pytest.approx(min(max((raw - 0.3) / 0.4, 0.0), 1.0), abs=1e-12)
    assert scored.columns == [*df.columns, "anomaly_raw", "anomaly_score_scaled", "anomalous"]
    # other columns stay in Spark
    assert "MapInPandas" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_a_forest_without_columns(spark):
    df = spark.range(300).withColumnRenamed("id", "trade_id")
    forest = anomaly.fit_anomaly(df, [], trees=3)
    assert {tuple(r) for r in anomaly.score_anomaly(df, forest).select("anomaly_score_scaled", "anomalous").collect()} == {(0.0, False)}


def test_vectors_are_assembled_once(spark):
    rows = [(i, date(2020, 1, 1), float(i % 2), i % 7 / 10, 1.0, i % 5 / 1.0, i % 11 / 1.0) for i in range(300)]
    df = spark.createDataFrame(
        rows, "trade_id long, transaction_date date, profitable double, actual_return double, sample_weight double, a double, b double")
    small = {k: {"maxIter": 1, "maxDepth": 1} for k in ("classifier", "regressor", "boosted")}
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    fitted = models.fit_all(df, ["a", "b"], small, trees=2, valid=df)
    assert list(fitted) == ["trade_predictor", "return_predictor", "anomaly_detector", "boosted", "ensemble"]
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before  # what the fits share is let go
    out = models.with_base_outputs(df, fitted, ["a", "b"], boosted=True)
    apart = models.proba(fitted["boosted"], models.predicted(fitted["return_predictor"], models.proba(
        fitted["trade_predictor"], df, "trade_predictor_proba"), "return_predictor_score"), "boosted_proba")
    names = ["trade_id", "trade_predictor_proba", "return_predictor_score", "boosted_proba"]
    assert sorted(out.select(names).collect()) == sorted(apart.select(names).collect())
    plans = [d.select(names)._jdf.queryExecution().optimizedPlan().toString() for d in (out, apart)]
    assert [p.count("UDF(struct(") for p in plans] == [1, 3]  # the assembler's
