"""Aggregate reports over the domain tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F


def _within(when: str, as_of: date | str, days: int) -> Column:
    """Whether a day lies in the ``days`` up to ``as_of``, both ends included."""
    end = F.lit(str(as_of)).cast("date")
    return F.col(when).cast("date").between(F.date_sub(end, days), end)


def trade_totals(trades: DataFrame, as_of: date | str) -> DataFrame:
    """Number of trades, distinct member names and disclosures of the last week."""
    recent = _within("disclosure_date", as_of, 7)
    return trades.agg(
        F.count("*").alias("total_trades"), F.count_distinct("member_name").alias("total_members"),
        F.count_if(recent).alias("recent_trades_7d"))


def top_tickers(trades: DataFrame, n: int = 10) -> DataFrame:
    return (
        trades.filter("ticker is not null").groupBy("ticker").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "ticker").limit(n))


def top_members(trades: DataFrame, n: int = 10) -> DataFrame:
    return (
        trades.groupBy("member_name").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_last("member_name")).limit(n))


def media_stats(media: DataFrame, sentiment: DataFrame, as_of: date | str) -> DataFrame:
    """Rows (figure, key, n): total, by source, last week, last week's labels."""
    week = _within("published_date", as_of, 7)
    by_source = media.groupBy("source_type").agg(F.count("*").alias("n"), F.count_if(week).alias("n7"))
    figure = lambda name, key, n: F.struct(
        F.lit(name).alias("figure"), key.alias("key"), F.col(n).alias("n"))
    figures = by_source.select(F.explode(F.array(
        figure("total_content", F.lit(""), "n"), figure("by_source_type", F.col("source_type"), "n"),
        figure("content_last_7_days", F.lit(""), "n7"),
    )).alias("f")).groupBy("f.figure", "f.key").agg(F.sum("f.n").alias("n"))
    labels = (
        sentiment.join(media.filter(week).select("media_id"), "media_id").filter("sentiment_label is not null")
        .groupBy(F.lit("recent_sentiment").alias("figure"), F.col("sentiment_label").alias("key"))
        .agg(F.count("*").alias("n")))
    return figures.unionByName(labels)


def sentiment_timeline(media: DataFrame, sentiment: DataFrame, member: str, days: int, as_of: date | str) -> DataFrame:
    """Daily mean score of a member's media since ``days`` before."""
    return (
        media.filter(F.array_contains("member_bioguide_ids", member))
        .filter(_within("published_date", as_of, days)).select("media_id", "published_date")
        .join(sentiment.select("media_id", "sentiment_score"), "media_id")
        .groupBy(F.col("published_date").alias("date"))
        .agg(F.round(F.avg("sentiment_score"), 4).alias("avg_score"), F.count("*").alias("count")))


def prediction_stats(predictions: DataFrame) -> DataFrame:
    """Per type and overall (null type): predictions and mean confidence."""
    return predictions.rollup("prediction_type").agg(
        F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))


def accuracy_5d(predictions: DataFrame) -> DataFrame:
    """Share of realised profitability predictions whose label fits the sign."""
    label, ret = F.col("predicted_label"), F.col("actual_return_5d")
    fits = ((label == "profitable") & (ret > 0)) | ((label == "unprofitable") & (ret <= 0))
    return (
        predictions.filter((F.col("prediction_type") == "profitability") & ret.isNotNull())
        .agg(F.avg(fits.cast("double")).alias("accuracy_5d"), F.count("*").alias("n")))


def leaderboard(predictions: DataFrame, trades: DataFrame, n: int | None = 20, least: int = 5) -> DataFrame:
    """Members by number of profitability predictions, with realised wins.

    Accuracy divides realised wins by all predictions, pending ones included.
    """
    p = predictions.filter("prediction_type = 'profitability'").select(
        "trade_id", "predicted_label", "actual_return_5d", "confidence")
    table = (
        p.join(trades.select("trade_id", "member_name", "member_bioguide_id"), "trade_id")
        .groupBy("member_name", "member_bioguide_id")
        .agg(
            F.count("*").alias("total_trades"),
            F.count_if(F.col("predicted_label") == "profitable").alias("predicted_profitable"),
            F.count_if(F.col("actual_return_5d") > 0).alias("actual_profitable"),
            F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
        .filter(F.col("total_trades") >= least)
        .withColumn("accuracy", F.col("actual_profitable") / F.col("total_trades")))
    if n is None:
        return table
    return table.orderBy(F.desc("total_trades"), "member_name", F.asc_nulls_last("member_bioguide_id")).limit(n)


def signal_stats(signals: DataFrame) -> DataFrame:
    """Active signals by type, by direction and overall, in one pass."""
    return (
        signals.filter("is_active")
        .groupingSets([["signal_type"], ["direction"], []], "signal_type", "direction")
        .agg(F.grouping_id().alias("grouping"), F.count("*").alias("n"), F.avg("strength").alias("avg_strength")))


def strength_by_type(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal_type").agg(F.avg("strength").alias("avg_strength"), F.count("*").alias("n"))


def committee_counts(assignments: DataFrame) -> DataFrame:
    """Seats per member."""
    return assignments.groupBy("member_bioguide_id").agg(F.count("*").alias("committee_count"))


def lobby_counts(clients: DataFrame, filings: DataFrame) -> DataFrame:
    """Distinct filings per resolved ticker."""
    named = clients.filter("matched_ticker is not null").select("client_id", F.col("matched_ticker").alias("ticker"))
    return filings.join(named, "client_id").groupBy("ticker").agg(
        F.count_distinct("filing_uuid").alias("filing_count"))


def donor_counts(contributions: DataFrame, committees: DataFrame) -> DataFrame:
    """Contributions per (member, resolved ticker).

    Contributions are counted per committee before they meet the members.
    """
    counted = contributions.filter("matched_ticker is not null").groupBy("fec_committee_id", "matched_ticker").agg(
        F.count("*").alias("n"))
    owners = committees.filter("member_bioguide_id is not null").select("fec_committee_id", "member_bioguide_id")
    return counted.join(owners, "fec_committee_id").groupBy(
        "member_bioguide_id", F.col("matched_ticker").alias("ticker")).agg(F.sum("n").alias("contribution_count"))


def trade_degree(trades: DataFrame) -> DataFrame:
    """Distinct tickers per member."""
    return trades.filter("ticker is not null and member_bioguide_id is not null").groupBy("member_bioguide_id").agg(
        F.count_distinct("ticker").alias("degree"))


def freshness(trades: DataFrame, as_of: date | str, loaded: str = "created_at") -> DataFrame:
    """Rows loaded in the last week, and whether there are any."""
    n = F.count_if(_within(loaded, as_of, 7))
    return trades.agg(n.alias("recent_trades_7d")).select(
        F.when(F.col("recent_trades_7d") > 0, "ok").otherwise("warning").alias("status"), "recent_trades_7d")


def assignments_by_congress(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("congress_number").agg(F.count("*").alias("n"))


def link_coverage(trades: DataFrame) -> DataFrame:
    """Linked and unlinked trades."""
    return trades.agg(
        F.count_if(F.col("member_bioguide_id").isNotNull()).alias("linked"),
        F.count_if(F.col("member_bioguide_id").isNull()).alias("unlinked"))


def screener_totals(recommendations: DataFrame, portfolio_size: float) -> DataFrame:
    """Invested amount and remaining cash."""
    total = F.coalesce(F.sum("suggested_amount"), F.lit(0.0))
    return recommendations.agg(F.count("*").alias("num_recommendations"), total.alias("total")).select(
        "num_recommendations", F.round("total", 2).alias("total_investable"),
        F.round(F.lit(float(portfolio_size)) - F.col("total"), 2).alias("cash_remainder"))
