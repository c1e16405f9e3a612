"""Models that are saved, loaded again and rotated."""

from datetime import datetime

from pyspark.sql import functions as F

from filinglens.learn import models
from filinglens.operators import merge

SMALL = {k: {"maxIter": 2, "maxDepth": 2} for k in ("classifier", "regressor", "boosted")}
COLUMNS = ["a", "b"]


def test_scoring_from_saved_models_equals_scoring_in_memory(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").alias("trade_id"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 7 % 23).cast("double").alias("b"),
        (F.col("id") % 3 == 0).cast("int").alias("profitable"), ((F.col("id") % 11 - 5) / 50).alias("actual_return"),
        F.lit(1.0).alias("sample_weight"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("transaction_date"))
    fitted = models.fit_all(rows, COLUMNS, SMALL, 4)
    first = models.save_models(spark, fitted, COLUMNS, str(tmp_path), datetime(2024, 1, 1))
    second = models.save_models(spark, fitted, COLUMNS, str(tmp_path), datetime(2024, 2, 1), first.count())
    table = merge.activate_latest(first.unionByName(second))
    loaded, columns, ids = models.load_active(table)
    assert columns == COLUMNS and set(loaded) == set(fitted)
    assert set(ids.values()) == set(range(len(fitted), 2 * len(fitted)))  # the later version took over
    in_memory = models.score_trades(rows, fitted, COLUMNS, ids)
    again = models.score_trades(rows, loaded, columns, ids)
    assert in_memory.exceptAll(again).count() == 0 and again.count() == in_memory.count() > 0
