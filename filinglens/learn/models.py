"""Boosted trees, stacking and their training, scoring and tuning jobs."""

from __future__ import annotations

import random
from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..operators import merge, metrics
from ..plans.dataset import build_dataset, chosen_trades, clean, common_groups, select_features, with_outcomes
from ..session import Scratch, durable, shared_dir
from .anomaly import Forest, grow_forest, scaled_anomaly, score_anomaly, set_range
from .folds import cut_rows, final_cuts, final_split, positioned, purged_folds

CLASSIFIER = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "minInstancesPerNode": 20, "seed": 42}
REGRESSOR = {"maxIter": 300, "maxDepth": 5, "stepSize": 0.1, "seed": 42}
BOOSTED = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "minInstancesPerNode": 20, "seed": 42}
SEARCH = {
    "maxIter": (200, 1000), "maxDepth": (3, 8), "stepSize": (0.01, 0.2), "minInstancesPerNode": (10, 100),
    "subsamplingRate": (0.6, 1.0), "featureSubset": (0.6, 1.0),
}


def balanced(train: DataFrame, label: str = "profitable", weight: str | None = "sample_weight") -> DataFrame:
    """Adds _weight: class balance n/(2·count) times the sample weight."""
    counts = train.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"), F.count("*").alias("_k"))
    table = counts.crossJoin(total).select(label, (F.col("_t") / (F.col("_k") * F.col("_c"))).alias("_weight"))
    out = train.join(F.broadcast(table), label)  # one row per class
    return out.withColumn("_weight", F.col("_weight") * F.col(weight)) if weight else out


def _assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features")


def _pipeline(columns: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[_assembler(columns), estimator])


def _fitted(columns: list[str], estimator, rows: DataFrame) -> PipelineModel:
    """The fitted pipeline; rows may bring their features vector."""
    if "features" not in rows.columns:
        return _pipeline(columns, estimator).fit(rows)
    return PipelineModel([_assembler(columns), estimator.fit(rows)])


def fit_classifier(train: DataFrame, columns: list[str], **params) -> PipelineModel:
    """Profitability classifier, balanced and sample-weighted."""
    gbt = GBTClassifier(labelCol="profitable", weightCol="_weight", **{**CLASSIFIER, **params})
    return _fitted(columns, gbt, balanced(train))


def fit_regressor(train: DataFrame, columns: list[str], **params) -> PipelineModel:
    """Return regressor, sample-weighted."""
    gbt = GBTRegressor(labelCol="actual_return", weightCol="sample_weight", **{**REGRESSOR, **params})
    return _fitted(columns, gbt, train)


def fit_boosted(
    train: DataFrame, columns: list[str], valid: DataFrame | None = None, held_share: float = 0.2, **params,
) -> PipelineModel:
    """Second classifier that stops where its validation rows' loss stops falling.

    ``valid`` holds the rows that the fold validates on, with equal weights; without
    one (a model fitted on all rows) a hash share of the training rows is held out.
    """
    rows = balanced(train)
    if valid is None:
        rows = rows.withColumn("_held", F.pmod(F.xxhash64("trade_id"), F.lit(1000)) < int(held_share * 1000))
    else:
        held = valid.select(*train.columns, F.lit(1.0).alias("_weight"), F.lit(True).alias("_held"))
        rows = rows.withColumn("_held", F.lit(False)).unionByName(held)
    gbt = GBTClassifier(
        labelCol="profitable", weightCol="_weight", validationIndicatorCol="_held", **{**BOOSTED, **params})
    return _fitted(columns, gbt, rows)


def fit_stack(meta: DataFrame) -> PipelineModel:
    """Logistic regression over the five base outputs (unit ridge penalty)."""
    lr = LogisticRegression(
        labelCol="profitable", regParam=1.0 / max(meta.count(), 1), elasticNetParam=0.0, maxIter=1000, standardization=False)
    return _fitted(K.META_FEATURES, lr, meta)


def proba(model, df: DataFrame, name: str) -> DataFrame:
    """Adds the probability of class 1; ``model`` is a pipeline, or its last stage for rows with their vector."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def predicted(model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).select(*df.columns, F.col("prediction").alias(name))


def anomaly_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in K.ANOMALY_EXCLUDED_FEATURES]


def with_base_outputs(df: DataFrame, models: dict, columns: list[str], boosted: bool = False) -> DataFrame:
    """Base model outputs as meta features, and ``boosted`` as boosted_proba; features that are absent count as 0."""
    return _named_anomaly(_base_outputs(df, models, columns, boosted), models)


def _named_anomaly(df: DataFrame, models: dict) -> DataFrame:
    """Rows with anomaly_raw: the score on the forest's range as anomaly_score."""
    rest = [c for c in df.columns if c not in ("anomaly_score_scaled", "anomalous")]
    return scaled_anomaly(df.select(*rest), models["anomaly_detector"]).withColumnRenamed("anomaly_score_scaled", "anomaly_score")


def _base_outputs(df: DataFrame, models: dict, columns: list[str], boosted: bool = False) -> DataFrame:
    out = _assembler(columns).transform(df)  # once for all models
    out = proba(models["trade_predictor"].stages[-1], out, "trade_predictor_proba")
    out = predicted(models["return_predictor"].stages[-1], out, "return_predictor_score")
    if boosted:
        out = proba(models["boosted"].stages[-1], out, "boosted_proba")
    out = score_anomaly(out.drop("features"), models["anomaly_detector"])
    missing = [c for c in K.META_FEATURES if c not in out.columns and c != "anomaly_score"]
    return out.withColumns({c: F.lit(0.0) for c in missing})


def evaluate_proba(df: DataFrame, column: str) -> dict[str, float]:
    """accuracy, precision, recall, f1 and auc of a probability column."""
    scored = df.select(
        F.col("profitable").cast("int").alias("y_true"), (F.col(column) > 0.5).cast("int").alias("y_pred"),
        F.col(column).alias("y_proba"))
    row = metrics.classifier_metrics(scored).crossJoin(metrics.auc(scored)).first()
    return {k: float(v) for k, v in row.asDict().items()}


def fit_all(
    train: DataFrame, columns: list[str], params: dict | None = None, trees: int = 200, valid: DataFrame | None = None,
) -> dict:
    """All base models and the stack, fitted on one training set; the boosted one stops by ``valid``, where given.

    ``train`` is read several times and should lie in a stored table.
    """
    params = params or {}
    scratch = Scratch(train.sparkSession, "fit")
    # each fit reads its rows several times: the vectors are put together once for all three
    vectors = _assembler(columns).transform(train).select(
        "trade_id", "profitable", "actual_return", "sample_weight", "features").persist()
    held = None if valid is None else _assembler(columns).transform(valid)
    models = {
        "trade_predictor": fit_classifier(vectors, columns, **params.get("classifier", {})),
        "return_predictor": fit_regressor(vectors, columns, **params.get("regressor", {})),
        "anomaly_detector": grow_forest(train, anomaly_columns(columns), trees),
        "boosted": fit_boosted(vectors, columns, held, **params.get("boosted", {})),
    }
    vectors.unpersist()
    # the forest scores the training rows once, for its range and for the stack
    scored = scratch.keep(_base_outputs(train, models, columns).select(
        "profitable", "anomaly_raw", *[c for c in K.META_FEATURES if c != "anomaly_score"]))
    set_range(models["anomaly_detector"], scored)
    meta = _named_anomaly(scored.select("profitable", "anomaly_raw", *[c for c in K.META_FEATURES if c != "anomaly_score"]), models)
    models["ensemble"] = fit_stack(scratch.keep(meta.select("profitable", *K.META_FEATURES)))
    scratch.clear()  # the models are fitted
    return models


def evaluate_all(valid: DataFrame, models: dict, columns: list[str]) -> dict[str, dict[str, float]]:
    """Metrics of every model on one validation set."""
    scratch = Scratch(valid.sparkSession, "evaluate")
    scored = with_base_outputs(valid, models, columns, boosted=True)
    scored = scratch.keep(proba(models["ensemble"], scored, "ensemble_proba").select(
        "profitable", "actual_return", "trade_predictor_proba", "return_predictor_score", "anomaly_score", "anomalous",
        "boosted_proba", "ensemble_proba"))
    out = {
        "trade_predictor": evaluate_proba(scored, "trade_predictor_proba"),
        "boosted": evaluate_proba(scored, "boosted_proba"), "ensemble": evaluate_proba(scored, "ensemble_proba"),
    }
    reg = metrics.regressor_metrics(scored.select(
        F.col("actual_return").alias("y_true"), F.col("return_predictor_score").alias("y_pred"))).first()
    out["return_predictor"] = {k: float(v) for k, v in reg.asDict().items()}
    anomaly = metrics.anomaly_summary(scored.select("anomalous", F.col("anomaly_score").alias("score"))).first()
    out["anomaly_detector"] = {k: float(v or 0.0) for k, v in anomaly.asDict().items()}
    scratch.clear()
    return out


def metric_rows(spark, per_fold: list[tuple[int, dict]]) -> DataFrame:
    rows = [(fold, model, name, value) for fold, found in per_fold for model, ms in found.items() for name, value in ms.items()]
    return spark.createDataFrame(rows, "fold int, model string, metric string, value double")


def _trained_on(df: DataFrame, columns: list[str]) -> DataFrame:
    """What a fit reads of the frame, without gaps."""
    needed = ["trade_id", "transaction_date", "profitable", "actual_return", "sample_weight", *columns,
              *[c for c in K.META_FEATURES if c in df.columns]]
    return clean(df, columns).select(*dict.fromkeys(needed))


def train_cv(df: DataFrame, columns: list[str], n: int = 5, params: dict | None = None, trees: int = 200) -> DataFrame:
    """(fold, model, metric, value) over purged walk-forward folds."""
    scratch = Scratch(df.sparkSession, "folds")
    rows = cut_rows(_trained_on(df, columns), n, scratch.keep)
    per_fold = []
    for fold in purged_folds(rows, n):
        valid = rows.filter(fold.validate())
        models = fit_all(rows.filter(fold.train()), columns, params, trees, valid)
        per_fold.append((fold.number, evaluate_all(valid, models, columns)))
    scratch.clear()
    return metric_rows(df.sparkSession, per_fold)


def search_space(n: int, seed: int = 42) -> list[dict]:
    """n seeded parameter sets within the search ranges."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lo, hi = SEARCH["stepSize"]
        out.append({
            "maxIter": rng.randint(*SEARCH["maxIter"]), "maxDepth": rng.randint(*SEARCH["maxDepth"]),
            "stepSize": lo * (hi / lo) ** rng.random(), "minInstancesPerNode": rng.randint(*SEARCH["minInstancesPerNode"]),
            "subsamplingRate": rng.uniform(*SEARCH["subsamplingRate"]),
            "featureSubsetStrategy": f"{rng.uniform(*SEARCH['featureSubset']):.3f}",
        })
    return out


def tune(df: DataFrame, columns: list[str], trials: list[dict], n_folds: int = 3) -> tuple[dict, DataFrame]:
    """(best parameters, all trials with mean fold AUC), best mean AUC wins."""
    rows = positioned(clean(df, columns))
    folds = [
        (durable(rows.filter(f.train())), durable(rows.filter(f.validate()))) for f in purged_folds(rows, n_folds)]
    results = []
    for i, params in enumerate(trials):
        scores = [
            evaluate_proba(proba(fit_classifier(train, columns, **params), valid, "p"), "p")["auc"] for train, valid in folds]
        results.append((i, str(params), sum(scores) / len(scores) if scores else 0.5))
    best = max(results, key=lambda r: (r[2], -r[0]))[0] if results else None
    table = df.sparkSession.createDataFrame(results, "trial int, params string, mean_auc double")
    return (trials[best] if best is not None else {}), table


def importance(model: PipelineModel, columns: list[str]) -> DataFrame:
    """(feature, importance) of a fitted tree model."""
    from pyspark.sql import SparkSession

    weights = model.stages[-1].featureImportances.toArray()
    return SparkSession.active().createDataFrame(
        [(c, float(w)) for c, w in zip(columns, weights)], "feature string, importance double")


def top_features(table: DataFrame, n: int = 15) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def score_trades(df: DataFrame, models: dict, columns: list[str], artifact_ids: dict[str, int] | None = None) -> DataFrame:
    """Predictions of all models on unscored trades, one row per model.

    Confidence is the doubled distance from one half for probabilities, ten
    times the size of a predicted return, or the anomaly score, capped at 1.
    """
    ids = artifact_ids or {}
    scored = durable(with_base_outputs(clean(df, columns), models, columns, boosted="boosted" in models))

    def rows(name: str, kind: str, value, label, confidence) -> DataFrame:
        return scored.select(
            "trade_id", F.lit(ids.get(name)).cast("long").alias("artifact_id"), F.lit(name).alias("model_name"),
            F.lit(kind).alias("prediction_type"), value.alias("predicted_value"), label.alias("predicted_label"),
            confidence.alias("confidence"))

    def by_proba(name: str, column: str) -> DataFrame:
        p = F.col(column)
        return rows(name, "profitability", p, F.when(p > 0.5, "profitable").otherwise("unprofitable"), F.abs(p - 0.5) * 2)

    r, a = F.col("return_predictor_score"), F.col("anomaly_score")
    out = (
        by_proba("trade_predictor", "trade_predictor_proba")
        .unionByName(rows("return_predictor", "return_5d", r, F.when(r > 0, "positive").otherwise("negative"),
                          F.least(F.abs(r) * 10, F.lit(1.0))))
        .unionByName(rows("anomaly_detector", "anomaly", a, F.when(F.col("anomalous"), "anomalous").otherwise("normal"), a)))
    return out.unionByName(by_proba("boosted", "boosted_proba")) if "boosted" in models else out


ARTIFACT = ("artifact_id long, model_name string, model_version string, artifact_path string, feature_columns array<string>, "
            "trained_at timestamp")


def save_models(spark, models: dict, columns: list[str], root: str, at: datetime, first_id: int = 0) -> DataFrame:
    """Write every model below ``root`` under the version of ``at``; one artifact row each, numbered from ``first_id``."""
    version, saved = at.strftime("%Y%m%d_%H%M%S"), []
    for i, (name, model) in enumerate(models.items()):
        path = f"{root}/{name}/{version}"
        if name == "anomaly_detector":
            model.write(spark, path)
        else:
            model.write().overwrite().save(path)
        saved.append((first_id + i, name, version, path, columns, at))
    return spark.createDataFrame(saved, ARTIFACT)


def load_active(artifacts: DataFrame) -> tuple[dict, list[str], dict[str, int]]:
    """(models by name, their feature columns, artifact ids) of the active artifacts, as ``score_trades`` takes them."""
    spark = artifacts.sparkSession
    models, columns, ids = {}, [], {}
    for r in artifacts.where("is_active").orderBy("artifact_id").collect():  # one row per model
        name, path = r["model_name"], r["artifact_path"]
        models[name] = Forest.read(spark, path) if name == "anomaly_detector" else PipelineModel.load(path)
        if columns and list(r["feature_columns"]) != columns:
            raise ValueError(f"{name} was trained on other columns than the models before it")
        columns, ids[name] = list(r["feature_columns"]), r["artifact_id"]
    return models, columns, ids


def train_all(t, options, folds: int = 5, params: dict | None = None, trees: int = 200, at: datetime | None = None,
              artifacts: DataFrame | None = None) -> DataFrame:
    """Train, evaluate, save under the shared folder and activate.

    Returns the artifact table: model, version, path, metrics, active flag. The
    version is that of ``at``, or of the options' as_of. Earlier ``artifacts`` stay
    in the table, inactive; new ids follow theirs.
    """
    parts, whole = Scratch(t.spark, "parts"), Scratch(t.spark, "dataset")
    data = whole.keep(build_dataset(t, options, scratch=parts, texts=False))
    parts.clear()
    columns = select_features(data)
    summary = metrics.fold_summary(train_cv(data, columns, folds, params, trees))
    final = Scratch(t.spark, "final")
    rows = cut_rows(_trained_on(data, columns), 1, final.keep, final_cuts)
    fold = final_split(rows)
    models = fit_all(rows.filter(fold.train()) if fold else rows, columns, params, trees)
    final.clear()  # the models are fitted
    whole.clear()
    first = 0 if artifacts is None else artifacts.agg(F.coalesce(F.max("artifact_id") + 1, F.lit(0))).first()[0]
    root = f"{shared_dir(t.spark)}/models"
    table = save_models(
        t.spark, models, columns, root, at or datetime.combine(options.as_of, datetime.min.time()), first)
    measured = summary.groupBy(F.col("model").alias("model_name")).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "mean"))).alias("metrics"))
    table = table.join(measured, "model_name", "left")
    if artifacts is not None:
        table = table.unionByName(artifacts.select(*table.columns))
    return merge.activate_latest(table)


def compare_horizons(t, base_options, horizons: list[str], folds: int = 5, params: dict | None = None, trees: int = 200) -> DataFrame:
    """(horizon, model, metric, mean, std) for several label horizons.

    What no horizon changes is derived once, for the trades of the horizon that
    admits most. A horizon's frame is deleted when its metrics are known, and what it
    was built from as soon as it is stored, so the disk holds one horizon at a time.
    """
    from dataclasses import replace

    options = [replace(base_options, horizon=h) for h in horizons]
    groups = Scratch(t.spark, "groups")
    common = None
    if options and base_options.limit is None:  # a limit chooses other trades for each horizon
        widest = min(options, key=lambda o: K.HORIZON_BUFFER_DAYS[o.horizon])
        common = common_groups(t, chosen_trades(t, widest), widest, groups, texts=False)
    out = None
    for option in options:
        parts, whole = Scratch(t.spark, "parts"), Scratch(t.spark, "horizon")
        data = whole.keep(
            build_dataset(t, option, scratch=parts, texts=False) if common is None else with_outcomes(t, common, option, parts))
        parts.clear()
        table = metrics.fold_summary(train_cv(data, select_features(data), folds, params, trees)).select(
            F.lit(option.horizon).alias("horizon"), "*")
        whole.clear()
        out = table if out is None else out.unionByName(table)
    groups.clear()
    return out
