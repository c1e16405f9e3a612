"""The frame's groups share neither the disk nor, between horizons, their making."""

import os
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from filinglens.learn import models
from filinglens.operators import dayrange
from filinglens.plans import catalog_learning, dataset
from filinglens.plans.views import Tables
from filinglens.session import FREED, Scratch, shared_dir

SF = "/root/testdata/sf0.001"


def _folders(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file:")))


def _shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in local for d, _, files in os.walk(top) for f in files if f.startswith("shuffle_") and f.endswith(".data")}


def test_a_kept_table_leaves_no_shuffle_files(spark):
    before, was = _shuffle_files(spark), spark.conf.get(FREED)
    kept = Scratch(spark, "test").keep(spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count())
    assert kept.count() == 7 and spark.conf.get(FREED) == was
    until = time.time() + 20  # files go in the background; the count above leaves one for each of its tasks
    while len(_shuffle_files(spark) - before) > kept.rdd.getNumPartitions() and time.time() < until:
        time.sleep(0.2)
    assert len(_shuffle_files(spark) - before) <= kept.rdd.getNumPartitions()


def test_text_is_left_out_and_features_stay_in_order(spark):
    t = catalog_learning._pinned(Tables(spark, SF))
    whole, narrow = (dataset.build_dataset(t, catalog_learning.OPTIONS, texts=x) for x in (True, False))
    assert dataset.feature_columns(whole) == dataset.feature_columns(narrow)
    assert {c for c, kind in narrow.dtypes if kind == "string"} == {"trade_id", "ticker", "member_bioguide_id", "transaction_type"} - {"trade_id"}
    columns = ["trade_id", *dataset.feature_columns(narrow)]
    assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, narrow.select(columns).collect()))


def test_horizons_share_what_none_of_them_changes(spark, monkeypatch):
    t = catalog_learning._pinned(Tables(spark, SF))
    apart = {h: dataset.build_dataset(t, replace(catalog_learning.OPTIONS, horizon=h), texts=False) for h in ("5d", "21d")}
    made, frames = [], []
    group = dayrange.legislative_features
    monkeypatch.setattr(dayrange, "legislative_features", lambda *a: made.append(1) or group(*a))

    def cv(data, columns, *_):
        frames.append({tuple(r) for r in data.select("trade_id", *(F.round(c, 9) for c in columns)).collect()})
        return models.metric_rows(spark, [(0, {"m": {"auc": 0.5}})])

    monkeypatch.setattr(models, "train_cv", cv)
    out = models.compare_horizons(t, catalog_learning.OPTIONS, ["5d", "21d"])
    assert [r.horizon for r in out.collect()] == ["5d", "21d"] and len(made) == 1
    for frame, df in zip(frames, apart.values()):
        columns = dataset.select_features(df)
        assert frame == {tuple(r) for r in df.select("trade_id", *(F.round(c, 9) for c in columns)).collect()}


@pytest.mark.parametrize("same", [False, True])
def test_hearings_are_counted_once_per_set_of_seats(spark, same):
    trades = spark.createDataFrame(
        [(1, "m", "2023-06-01"), (1, "m", "2023-06-01"), (2, "n", "2023-06-01"), (3, None, "2023-06-01"), (4, "m", None), (5, "o", "2023-06-01")],
        "trade_id long, member_bioguide_id string, d string").withColumn("transaction_date", F.to_date("d"))
    seats = spark.createDataFrame(
        [("m", "a", 118), ("m", "a", 118), ("m", "b", 117), ("n", "b", 117), ("n", "a", 118), ("o", None, 118), ("o", "a", None)],
        "member_bioguide_id string, committee_code string, congress_number int")
    hearings = spark.createDataFrame([(1, "a", "2023-06-03"), (2, "a", "2023-05-30"), (3, "b", "2023-06-01"), (4, "b", "2023-07-02")],
        "hearing_id long, committee_code string, d string").withColumn("hearing_date", F.to_date("d"))
    df = dayrange.hearing_proximity(trades, seats, hearings, same)
    expected = (2, 1, 1, 1, 2) if same else (3, 1, 1, 1, 0)
    assert sorted(map(tuple, df.collect())) == [(1, *expected), (1, *expected), (2, *expected)]
    assert "collect_set" in df._jdf.queryExecution().analyzed().toString()
