"""Signal generators, duplicate suppression, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..functions.features import signal_scores

EVIDENCE = {
    "trade_id": "long", "prediction_id": "long", "anomaly_score": "double", "avg_sentiment_30d": "double",
    "cluster_size": "long", "lobbying_amount": "double", "member_name": "string", "transaction_type": "string",
    "predicted_value": "double", "amount_range": "string", "divergence_type": "string", "members": "array<struct<name string, bioguide_id string>>",
}
SIGNAL_COLUMNS = [
    "signal_type", "member_bioguide_id", "ticker", "direction", "strength", "confidence", "evidence", "created_at",
    "expires_at", "is_active",
]


def evidence(**fields: Column) -> Column:
    """Evidence struct; absent fields are null."""
    return F.struct(*[
        (fields[name].cast(kind) if name in fields else F.lit(None).cast(kind)).alias(name)
        for name, kind in EVIDENCE.items()])


def score_signals(df: DataFrame) -> DataFrame:
    """Adds strength and replaces confidence by its capped, rounded value."""
    return df.withColumns(signal_scores())


def _finish(df: DataFrame, as_of: Column) -> DataFrame:
    life = F.create_map(*[F.lit(v) for kv in K.SIGNAL_LIFETIME_DAYS.items() for v in kv])[F.col("signal_type")]
    scored = score_signals(df)
    return scored.select(
        "signal_type", "member_bioguide_id", "ticker", "direction", "strength", "confidence", "evidence",
        as_of.alias("created_at"), (as_of + F.make_dt_interval(days=life)).alias("expires_at"), F.lit(True).alias("is_active"))


def _within(when: Column | str, as_of: Column, days: int) -> Column:
    """Whether a moment lies in the ``days`` up to ``as_of``, both ends included."""
    return F.col(when).between(as_of - F.expr(f"interval {days} days"), as_of)


def suppress(
    candidates: DataFrame, signals: DataFrame, keys: Sequence[str], as_of: Column, order: Sequence[Column | str],
    days: int = 7,
) -> DataFrame:
    """Candidates without a signal of the same type and keys in the last days.

    Null keys match null keys. Within the run the first candidate per type and
    keys by the order is kept, chosen by an aggregate.
    """
    all_keys = ["signal_type", *keys]
    recent = signals.filter(_within("created_at", as_of, days)).select(
        *[F.col(k).alias(f"_{k}") for k in all_keys]).distinct()
    row = F.struct(*candidates.columns)
    first = candidates.groupBy(*[F.col(k).alias(f"_g{k}") for k in all_keys]).agg(
        F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")
    on = F.lit(True)
    for k in all_keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return first.join(recent, on, "left_anti")


def _lag() -> Column:
    return F.datediff("disclosure_date", "transaction_date")


def _predicted(predictions: DataFrame, trades: DataFrame, as_of: Column, condition: Column) -> DataFrame:
    recent = predictions.filter(condition & _within("created_at", as_of, 7))
    return recent.select(
        "prediction_id", "trade_id", "predicted_label", "predicted_value", "confidence").join(trades, "trade_id")


def trade_follow(predictions: DataFrame, trades: DataFrame, signals: DataFrame, as_of: Column) -> DataFrame:
    """Follows confident profitability predictions of the last week.

    The direction is that of the predicted label, whatever the trade was.
    """
    rows = _predicted(
        predictions, trades, as_of, (F.col("prediction_type") == "profitability") & (F.col("confidence") > 0.7))
    found = rows.select(
        F.lit("trade_follow").alias("signal_type"), "member_bioguide_id", "ticker",
        F.when(F.col("predicted_label") == "profitable", "bullish").otherwise("bearish").alias("direction"),
        "confidence", _lag().alias("disclosure_lag_days"),
        evidence(trade_id=F.col("trade_id"), prediction_id=F.col("prediction_id"), member_name=F.col("member_name"),
                 transaction_type=F.col("transaction_type"),
                 predicted_value=F.coalesce("predicted_value", F.lit(0.0))).alias("evidence"),
        F.col("prediction_id").alias("_order"))
    return _finish(suppress(found, signals, ["ticker", "member_bioguide_id"], as_of, ["_order"]), as_of)


def anomaly_alerts(predictions: DataFrame, trades: DataFrame, signals: DataFrame, as_of: Column) -> DataFrame:
    """Flags trades predicted anomalous in the last week."""
    rows = _predicted(
        predictions, trades, as_of,
        (F.col("prediction_type") == "anomaly") & (F.col("predicted_label") == "anomalous"))
    found = rows.select(
        F.lit("anomaly_alert").alias("signal_type"), "member_bioguide_id", "ticker", F.lit("neutral").alias("direction"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit(None).cast("int").alias("disclosure_lag_days"),
        evidence(trade_id=F.col("trade_id"), anomaly_score=F.coalesce("predicted_value", F.lit(0.0)),
                 member_name=F.col("member_name"), transaction_type=F.col("transaction_type"),
                 amount_range=F.format_string("$%s-$%s", F.col("amount_range_low").cast("string"),
                                              F.col("amount_range_high").cast("string"))).alias("evidence"),
        F.col("prediction_id").alias("_order"))
    return _finish(suppress(found, signals, ["ticker", "member_bioguide_id"], as_of, ["_order"]), as_of)


def _recent_trades(trades: DataFrame, as_of: Column) -> DataFrame:
    return trades.filter(
        F.col("transaction_date").between(F.date_sub(as_of.cast("date"), 7), as_of.cast("date"))
        & F.col("ticker").isNotNull() & F.col("member_bioguide_id").isNotNull())


def sentiment_divergence(
    trades: DataFrame, media: DataFrame, sentiment: DataFrame, signals: DataFrame, as_of: Column,
) -> DataFrame:
    """Trades of the last week against the member's press of thirty days."""
    mood = (
        media.filter(F.col("published_date").between(F.date_sub(as_of.cast("date"), 30), as_of.cast("date")))
        .select("media_id", F.explode("member_bioguide_ids").alias("member_bioguide_id"))
        .join(sentiment.select("media_id", "sentiment_score"), "media_id")
        .groupBy("member_bioguide_id").agg(F.avg("sentiment_score").alias("mood")))
    bought = F.coalesce(F.col("transaction_type") == "purchase", F.lit(False))
    rows = _recent_trades(trades, as_of).join(mood, "member_bioguide_id").filter(
        (bought & (F.col("mood") < -0.2)) | (~bought & (F.col("mood") > 0.2)))
    found = rows.select(
        F.lit("sentiment_divergence").alias("signal_type"), "member_bioguide_id", "ticker",
        F.when(bought, "bullish").otherwise("bearish").alias("direction"),
        F.least(F.abs("mood") * 2, F.lit(1.0)).alias("confidence"), F.lit(None).cast("int").alias("disclosure_lag_days"),
        evidence(trade_id=F.col("trade_id"), avg_sentiment_30d=F.col("mood"), member_name=F.col("member_name"),
                 transaction_type=F.col("transaction_type"),
                 divergence_type=F.when(bought, "contrarian_buy").otherwise("insider_sell")).alias("evidence"),
        F.col("trade_id").alias("_order"))
    return _finish(suppress(found, signals, ["ticker", "member_bioguide_id"], as_of, ["_order"]), as_of)


def insider_clusters(trades: DataFrame, signals: DataFrame, as_of: Column, least: int = 3) -> DataFrame:
    """Three or more members in one ticker and direction within the week.

    Duplicates are judged by ticker alone: of two clusters in one ticker the
    larger is kept. Up to ten members are named as evidence.
    """
    who = _recent_trades(trades, as_of).groupBy("ticker", "transaction_type", "member_bioguide_id").agg(
        F.min("member_name").alias("member_name"))
    size = who.groupBy("ticker", "transaction_type").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    candidates = size.select(
        F.lit("insider_cluster").alias("signal_type"), F.lit(None).cast("string").alias("member_bioguide_id"), "ticker",
        F.when(F.col("transaction_type") == "purchase", "bullish").otherwise("bearish").alias("direction"),
        F.least(F.col("size") / 10.0, F.lit(1.0)).alias("confidence"), F.lit(None).cast("int").alias("disclosure_lag_days"),
        "size", "transaction_type")
    kept = suppress(candidates, signals, ["ticker"], as_of, [-F.col("size"), F.col("transaction_type")])
    named = who.join(kept.select("ticker", "transaction_type"), ["ticker", "transaction_type"], "left_semi")
    # ten smallest by name: partial top-tens per hash bucket keep groups small
    item = F.struct(F.col("member_name").alias("name"), F.col("member_bioguide_id").alias("bioguide_id"))
    ten = lambda c: F.slice(F.array_sort(c), 1, 10)
    part = named.groupBy("ticker", "transaction_type", F.pmod(F.xxhash64("member_bioguide_id"), F.lit(64)).alias("b")).agg(
        ten(F.collect_list(item)).alias("some"))
    listed = part.groupBy("ticker", "transaction_type").agg(ten(F.flatten(F.collect_list("some"))).alias("members"))
    rows = kept.join(listed, ["ticker", "transaction_type"])
    return _finish(
        rows.withColumn("evidence", evidence(
            cluster_size=F.col("size"), transaction_type=F.col("transaction_type"), members=F.col("members"))), as_of)


def generate_all(
    predictions: DataFrame, trades: DataFrame, media: DataFrame, sentiment: DataFrame, signals: DataFrame, as_of: Column,
) -> DataFrame:
    """The union of all generators at one point in time."""
    return (
        trade_follow(predictions, trades, signals, as_of)
        .unionByName(anomaly_alerts(predictions, trades, signals, as_of))
        .unionByName(sentiment_divergence(trades, media, sentiment, signals, as_of))
        .unionByName(insider_clusters(trades, signals, as_of)))


# --- alerts ---------------------------------------------------------------------------


#: Parts of the keys that any signal, or any of one type, can have.
ALERT_SALTS = 32


def match_alerts(signals: DataFrame, configs: DataFrame, salts: int = ALERT_SALTS) -> DataFrame:
    """(signal, config) pairs; an empty list in a config allows anything.

    A configuration is indexed by its most selective list: its members, else its
    tickers, else its types, else nothing. A signal looks up its member, ticker,
    type and the unlisted ones, so each pair meets once. The last two keys, which
    many signals share, are dealt to ``salts`` parts: their few configurations are
    copied to each, their signals go to one. The other conditions filter the pairs.
    """
    def listed(column: str) -> Column:
        return F.coalesce(F.col(column), F.array().cast("array<string>"))

    def prefixed(prefix: str, column: str) -> Column:
        return F.transform(F.array_distinct(listed(column)), lambda v: F.concat(F.lit(prefix), v))

    parts = F.sequence(F.lit(0), F.lit(salts - 1))
    salted = F.flatten(F.transform(prefixed("kind ", "signal_types"), lambda k: F.transform(parts, lambda i: F.concat(k, F.lit(" "), i.cast("string")))))
    keys = (
        F.when(F.size(listed("members")) > 0, prefixed("member ", "members")).when(F.size(listed("tickers")) > 0, prefixed("ticker ", "tickers"))
        .when(F.size(listed("signal_types")) > 0, salted).otherwise(F.transform(parts, lambda i: F.concat(F.lit("any "), i.cast("string")))))
    c = configs.filter("is_active").select(
        "config_id", F.col("name").alias("config_name"), "min_strength", "tickers", "members", "signal_types", F.explode(keys).alias("_key"))
    own = F.pmod(F.xxhash64("signal_id"), F.lit(salts)).cast("string")
    s = signals.withColumn("_key", F.explode(F.array_compact(F.array(
        F.concat(F.lit("member "), "member_bioguide_id"), F.concat(F.lit("ticker "), "ticker"),
        F.concat(F.lit("kind "), "signal_type", F.lit(" "), own), F.concat(F.lit("any "), own)))))

    def allowed(column: str, value: str) -> Column:
        return (F.size(listed(column)) == 0) | F.coalesce(F.array_contains(column, F.col(value)), F.lit(False))

    return s.join(c, "_key").filter(
        (F.col("strength") >= F.coalesce("min_strength", F.lit(0.0))) & allowed("tickers", "ticker")
        & allowed("members", "member_bioguide_id") & allowed("signal_types", "signal_type")).drop("_key", "signal_types")


def quiet_segments(matches: DataFrame, window_seconds: int, buckets: int = 6) -> DataFrame:
    """Adds _segment: stretches of a configuration parted by a full quiet window.

    Times are summed up per bucket (a fraction of the window), so the ordered
    window sees one row per configuration and bucket, never the matches.
    """
    width = window_seconds // buckets
    bucket = F.floor(F.unix_seconds("created_at") / width)
    spans = matches.groupBy("config_id", bucket.alias("_bucket")).agg(
        F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    w = Window.partitionBy("config_id").orderBy("_bucket")
    quiet = F.unix_micros("lo") - F.unix_micros(F.lag("hi").over(w)) >= window_seconds * 1000000
    starts = F.coalesce(quiet.cast("int"), F.lit(0))
    cut = spans.withColumn("_start", starts).select(
        "config_id", "_bucket", F.sum("_start").over(w).alias("_segment"))
    return matches.withColumn("_bucket", bucket).join(cut, ["config_id", "_bucket"]).drop("_bucket")


def rate_limit(matches: DataFrame, n: int = K.ALERTS_PER_HOUR, window_seconds: int = 3600) -> DataFrame:
    """Matches let through: at most n per configuration in any sliding window.

    What is let through depends on what was let through before, so matches are
    walked in time order, in sorted Arrow batches whose only state is the last n
    dispatch times. After a quiet window nothing is remembered, so a busy
    configuration is cut there and its stretches are walked in parallel.
    """
    columns = ["config_id", "_segment", "created_at", "signal_id"]
    slim = quiet_segments(matches.select("config_id", "created_at", "signal_id"), window_seconds)
    slim = slim.select(*columns).repartition("config_id", "_segment").sortWithinPartitions(*columns)

    def walk(batches):
        from collections import deque

        import numpy as np
        import pandas as pd

        current, sent = None, deque(maxlen=n)
        span = pd.Timedelta(seconds=window_seconds)
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for i, (cid, part, at) in enumerate(zip(batch["config_id"], batch["_segment"], batch["created_at"])):
                if (cid, part) != current:
                    current = (cid, part)
                    sent.clear()
                if len(sent) < n or sent[0] <= at - span:
                    sent.append(at)
                    keep[i] = True
            yield batch[keep]

    kept = slim.mapInPandas(walk, slim.schema)
    return matches.join(kept.select("config_id", "signal_id"), ["config_id", "signal_id"], "left_semi")


def alert_payloads(matches: DataFrame) -> DataFrame:
    """One JSON payload per dispatched match."""
    fields = ["signal_type", "ticker", "direction", "strength", "confidence", "evidence", "member_bioguide_id", "created_at"]
    return matches.select(
        "config_id", "config_name", "signal_id",
        F.to_json(F.struct(*[c for c in fields if c in matches.columns]), {"ignoreNullFields": "false"}).alias("payload"))
