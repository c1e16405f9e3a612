"""Training deletes what it wrote out when its metrics are known."""

import os
from datetime import date, timedelta

from filinglens.learn import models
from filinglens.session import shared_dir

SMALL = {k: {"maxIter": 1, "maxDepth": 1} for k in ("classifier", "regressor", "boosted")}


def test_folds_leave_no_tables_behind(spark):
    rows = [(i, date(2020, 1, 1) + timedelta(days=i), i % 2, i % 7 / 10, 1.0, i % 5 / 1.0) for i in range(400)]
    df = spark.createDataFrame(
        rows, "trade_id long, transaction_date date, profitable int, actual_return double, sample_weight double, amount_log double")
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    found = models.train_cv(df, ["amount_log"], 1, SMALL, trees=2)
    assert found.select("model").distinct().count() == 5
    for name in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before:
        left = [f for f in os.listdir(f"{shared_dir(spark)}/{name}")]
        assert not name.startswith(("folds-", "fit-", "evaluate-")) or not left
    assert any(n.startswith("folds-") for n in os.listdir(shared_dir(spark)))
