"""Buy recommendations from bullish signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import features as X
from .indicators import latest_close, risk_metrics


def live_bullish(signals: DataFrame, as_of: Column, min_strength: float = 0.3) -> DataFrame:
    """Active, unexpired bullish signals made by ``as_of``, with a ticker and enough strength."""
    return signals.filter(
        F.col("is_active") & (F.col("direction") == "bullish") & (F.col("strength") >= min_strength)
        & (F.col("ticker") != "") & (F.col("created_at") <= as_of) & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def freshness_score(live: DataFrame, as_of: Column) -> DataFrame:
    """Freshness of the newest signal per ticker."""
    return live.groupBy("ticker").agg(F.max(X.freshness("created_at", as_of)).alias("freshness"))


def candidates(signals: DataFrame, as_of: Column, min_strength: float = 0.3) -> DataFrame:
    """Per ticker: mean strength, freshness of the newest, number of signals."""
    return live_bullish(signals, as_of, min_strength).groupBy("ticker").agg(
        F.avg("strength").alias("avg_strength"), F.max(X.freshness("created_at", as_of)).alias("freshness"),
        F.count("*").alias("signal_count"), X.count_bonus(F.count("*")).alias("count_bonus"))


def ml_confidence(predictions: DataFrame, trades: DataFrame, as_of: Column) -> DataFrame:
    """Best confidence of a buy or profitable prediction per ticker in 30 days."""
    recent = predictions.filter(
        F.col("predicted_label").isin("buy", "profitable") & F.col("created_at").between(as_of - F.expr("interval 30 days"), as_of))
    best = recent.select("trade_id", "confidence").join(
        trades.filter("ticker is not null").select("trade_id", "ticker"), "trade_id").groupBy("ticker").agg(
        F.max("confidence").alias("c"))
    return best.select("ticker", F.coalesce(F.nullif("c", F.lit(0.0)), F.lit(0.5)).alias("ml_confidence"))


def signal_win_rate(live: DataFrame, predictions: DataFrame, trades: DataFrame) -> DataFrame:
    """Share of gains among the realised outcomes of a ticker's signalling members.

    Outcomes are counted per member first, then pooled over the members of each
    ticker; fewer than five give one half.
    """
    outcomes = predictions.filter("actual_return_5d is not null").select("trade_id", "actual_return_5d").join(
        trades.filter("member_bioguide_id is not null").select("trade_id", "member_bioguide_id"), "trade_id")
    per_member = outcomes.groupBy("member_bioguide_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("actual_return_5d") > 0).alias("wins"))
    who = live.filter("coalesce(member_bioguide_id, '') <> ''").select("ticker", "member_bioguide_id").distinct()
    pooled = who.join(per_member, "member_bioguide_id").groupBy("ticker").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"))
    return pooled.select(
        "ticker", F.when(F.col("n") < 5, 0.5).otherwise(F.col("wins") / F.col("n")).alias("best_win_rate"))


def collect_evidence(live: DataFrame) -> DataFrame:
    """Per ticker: members, signal types and the type of the strongest signal."""
    # the pairs are distinct before they are collected, so hot tickers shrink first
    members = live.filter("coalesce(member_bioguide_id, '') <> ''").select("ticker", "member_bioguide_id").distinct().groupBy(
        "ticker").agg(F.array_sort(F.collect_list("member_bioguide_id")).alias("member_names"))
    first = F.struct((-F.col("strength")).alias("s"), "signal_id")
    types = live.groupBy("ticker").agg(
        F.count("*").alias("signal_count"), F.array_sort(F.collect_set("signal_type")).alias("signal_types"),
        F.min_by(F.when(F.col("strength") > 0, F.col("signal_type")), first).alias("strongest_type"))
    none = F.array().cast("array<string>")
    return types.join(members, "ticker", "left").withColumn("member_names", F.coalesce("member_names", none))


def rank_recommendations(scored: DataFrame, n: int = 5) -> DataFrame:
    return scored.orderBy(F.desc("composite_score"), "ticker").limit(n)


def allocate(recommendations: DataFrame, portfolio_size: float) -> DataFrame:
    """Score-weighted shares within 10 to 40 percent, renormalised once."""
    totals = recommendations.agg(F.sum("composite_score").alias("_total"), F.count("*").alias("_n"))
    share = F.when(F.col("_total") == 0, 1.0 / F.col("_n")).otherwise(F.col("composite_score") / F.col("_total"))
    clamped = recommendations.crossJoin(F.broadcast(totals)).withColumn(
        "_pct", F.greatest(F.lit(0.10), F.least(F.lit(0.40), share)))
    whole = clamped.agg(F.sum("_pct").alias("_whole"))
    pct = F.when(F.col("_whole") > 0, F.col("_pct") / F.col("_whole")).otherwise(F.col("_pct"))
    amount = F.round(F.lit(float(portfolio_size)) * F.col("allocation_pct"), 2)
    shares = F.when(F.col("current_price") > 0, F.floor(F.col("suggested_amount") / F.col("current_price"))).otherwise(0)
    return (
        clamped.crossJoin(F.broadcast(whole)).withColumn("allocation_pct", pct).withColumn("suggested_amount", amount)
        .withColumn("suggested_shares", shares.cast("long")).drop("_pct", "_whole", "_total", "_n"))


def score_tickers(
    signals: DataFrame, predictions: DataFrame, trades: DataFrame, as_of: Column, min_strength: float = 0.3,
) -> DataFrame:
    """All candidate tickers with their part scores and composite score."""
    live = live_bullish(signals, as_of, min_strength)
    parts = (
        candidates(signals, as_of, min_strength)
        .join(ml_confidence(predictions, trades, as_of), "ticker", "left")
        .join(signal_win_rate(live, predictions, trades), "ticker", "left")
        .withColumn("ml_confidence", F.coalesce("ml_confidence", F.lit(0.5)))
        .withColumn("best_win_rate", F.coalesce("best_win_rate", F.lit(0.5))))
    return parts.withColumn("composite_score", F.round(X.composite_score(), 4))


def recommend(
    signals: DataFrame, predictions: DataFrame, trades: DataFrame, prices: DataFrame, as_of: Column,
    portfolio_size: float = 3000.0, top_n: int = 5, min_strength: float = 0.3,
) -> DataFrame:
    """The ranked, sized recommendations with evidence and risk."""
    top = rank_recommendations(score_tickers(signals, predictions, trades, as_of, min_strength), top_n)
    live = live_bullish(signals, as_of, min_strength)
    few = F.broadcast(top.select("ticker"))  # at most top_n rows
    bars = prices.join(few, "ticker", "left_semi")
    priced = top.join(latest_close(bars).select("ticker", "current_price"), "ticker", "left")
    sized = allocate(priced, portfolio_size)
    risk = risk_metrics(bars)
    risk = risk.select(
        "ticker", F.round("volatility_21d", 4).alias("volatility_21d"), F.round("rsi_14", 2).alias("rsi_14"),
        F.round("price_change_5d", 4).alias("price_change_5d"))
    proof = collect_evidence(live.join(few, "ticker", "left_semi")).drop("signal_count")
    return sized.join(risk, "ticker", "left").join(proof, "ticker", "left")
