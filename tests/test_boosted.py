"""Early stopping of the boosted model on the fold's validation rows."""

from pyspark.sql import functions as F

from filinglens.learn import models

COLUMNS = ["a", "b"]
PARAMS = {"maxIter": 25, "maxDepth": 3, "minInstancesPerNode": 5, "stepSize": 0.5}


def _rows(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(100)) < 25
    return spark.range(1200).select(
        F.col("id").alias("trade_id"), (F.col("id") % 31).cast("double").alias("a"), (F.col("id") * 7 % 53).cast("double").alias("b"),
        ((F.col("id") % 31 > 14) != noise).cast("int").alias("profitable"), F.lit(1.0).alias("sample_weight"))


def test_stops_where_the_validation_loss_does(spark):
    rows = _rows(spark).coalesce(1)
    train, valid = rows.filter("trade_id < 900"), rows.filter("trade_id >= 900")
    model = models.fit_boosted(train, COLUMNS, valid, **PARAMS).stages[-1]
    full = models._pipeline(COLUMNS, models.GBTClassifier(
        labelCol="profitable", weightCol="_weight", **{**models.BOOSTED, **PARAMS})).fit(models.balanced(train))
    vectors = full.stages[0].transform(valid.withColumn("_weight", F.lit(1.0))).withColumn("profitable", F.col("profitable").cast("double"))
    losses = full.stages[-1].evaluateEachIteration(vectors)
    best, kept = losses[0], 1
    for i, loss in enumerate(losses[1:], 2):
        if best - loss < 0.01 * max(loss, 0.01):
            break
        if loss < best:
            best, kept = loss, i
    assert model.getNumTrees == kept < PARAMS["maxIter"]


def test_without_validation_rows(spark):
    rows = _rows(spark)
    model = models.fit_boosted(rows, COLUMNS, **PARAMS)
    assert models.proba(model, rows, "p").filter("p between 0 and 1").count() == 1200
