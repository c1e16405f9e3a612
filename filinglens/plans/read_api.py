"""Parameterised read queries.

Every filter argument is optional and adds no predicate when absent. ``limit``
and ``offset`` page a total order that ends in the key; the order and the offset
hold without a limit, too.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F


def page(df: DataFrame, order: Sequence[Column | str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of a totally ordered result; without a limit, all from the offset on."""
    rows = df.orderBy(*order)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def _where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for cond in conditions:
        if cond is not None:
            df = df.filter(cond)
    return df


def _eq(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def _from(column: str, value) -> Column | None:
    return None if value is None else F.col(column) >= F.lit(value)


def _to(column: str, value) -> Column | None:
    return None if value is None else F.col(column) <= F.lit(value)


def _like(column: str, text: str | None) -> Column | None:
    return None if text is None else F.col(column).ilike(f"%{text}%")


def _holds(column: str, value: str | None) -> Column | None:
    return None if value is None else F.array_contains(column, value)


def list_trades(
    trades: DataFrame, member_name: str | None = None, ticker: str | None = None, chamber: str | None = None,
    transaction_type: str | None = None, filer_type: str | None = None, date_from: date | None = None,
    date_to: date | None = None, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Trades by name part, ticker, chamber, type, filer and dates, newest first."""
    found = _where(
        trades, _like("member_name", member_name), _eq("ticker", ticker and ticker.upper()),
        _eq("chamber", chamber and chamber.lower()), _eq("transaction_type", transaction_type and transaction_type.lower()),
        _eq("filer_type", filer_type and filer_type.lower()), _from("transaction_date", date_from),
        _to("transaction_date", date_to))
    return page(found, [F.desc("transaction_date"), "trade_id"], limit, offset)


def list_members(
    members: DataFrame, chamber: str | None = None, party: str | None = None, state: str | None = None,
    in_office: bool | None = None, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Members by chamber, party, state and office, by name."""
    found = _where(
        members, _eq("chamber", chamber and chamber.lower()), _eq("party", party), _eq("state", state and state.upper()),
        _eq("in_office", in_office))
    return page(found, ["full_name", "bioguide_id"], limit, offset)


def lookup(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """Rows whose key is one of the asked ids."""
    return df.filter(F.col(key).isin(list(ids)))


def member_trades(trades: DataFrame, member: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A member's trades, newest first."""
    return page(trades.filter(F.col("member_bioguide_id") == member), [F.desc("transaction_date"), "trade_id"], limit, offset)


def list_bills(
    bills: DataFrame, congress: int | None = None, bill_type: str | None = None, policy_area: str | None = None,
    sponsor: str | None = None, date_from: date | None = None, date_to: date | None = None,
    limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Bills by congress, type, policy-area part, sponsor and dates, newest first."""
    found = _where(
        bills, _eq("congress_number", congress), _eq("bill_type", bill_type and bill_type.lower()),
        _like("policy_area", policy_area), _eq("sponsor_bioguide_id", sponsor), _from("introduced_date", date_from),
        _to("introduced_date", date_to))
    return page(found, [F.desc("introduced_date"), "bill_id"], limit, offset)


def list_committees(
    committees: DataFrame, chamber: str | None = None, current_only: bool = True, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Committees by chamber, by default the current ones, by name."""
    found = _where(
        committees, _eq("chamber", chamber and chamber.lower()), F.col("is_current") if current_only else None)
    return page(found, ["name", "system_code"], limit, offset)


def committee_hearings(hearings: DataFrame, code: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Hearings of one committee, newest first."""
    return page(hearings.filter(F.col("committee_code") == code), [F.desc("hearing_date"), "hearing_id"], limit, offset)


def committee_trades(
    trades: DataFrame, assignments: DataFrame, code: str, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Trades by members of a committee, with role; once per seat held."""
    seats = assignments.filter(F.col("committee_code") == code).select("member_bioguide_id", "role", "committee_name")
    return page(trades.join(seats, "member_bioguide_id"), [F.desc("transaction_date"), "trade_id"], limit, offset)


def list_media(
    media: DataFrame, sentiment: DataFrame, source_type: str | None = None, date_from: date | None = None,
    date_to: date | None = None, ticker: str | None = None, member: str | None = None,
    limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Media by source, dates, ticker and member, each with one analysis.

    The analysis of the alphabetically first model is attached.
    """
    found = page(
        _where(
            media, _eq("source_type", source_type), _from("published_date", date_from), _to("published_date", date_to),
            _holds("tickers_mentioned", ticker), _holds("member_bioguide_ids", member)),
        [F.desc("published_date"), "media_id"], limit, offset)
    one = sentiment.groupBy("media_id").agg(
        F.min_by(F.struct("model_name", "sentiment_label", "sentiment_score", "confidence"), "model_name").alias("sentiment"))
    return found.join(one, "media_id", "left")


def get_media(media: DataFrame, sentiment: DataFrame, ids: Sequence | None = None) -> DataFrame:
    """Media items with all their analyses nested."""
    items = media if ids is None else lookup(media, "media_id", ids)
    analyses = sentiment.groupBy("media_id").agg(
        F.array_sort(F.collect_list(F.struct("model_name", "sentiment_label", "sentiment_score", "confidence")))
        .alias("sentiment_analyses"))
    return items.join(analyses, "media_id", "left")


def member_media(media: DataFrame, member: str, source_type: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Media that mention a member, newest first."""
    found = _where(media, _holds("member_bioguide_ids", member), _eq("source_type", source_type))
    return page(found, [F.desc("published_date"), "media_id"], limit, offset)


def list_predictions(
    predictions: DataFrame, trades: DataFrame, member: str | None = None, ticker: str | None = None,
    prediction_type: str | None = None, date_from: date | None = None, date_to: date | None = None,
    limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Predictions by attributes of their trade and by type, newest first."""
    t = _where(
        trades.select("trade_id", "member_bioguide_id", "ticker", "transaction_date"), _eq("member_bioguide_id", member),
        _eq("ticker", ticker), _from("transaction_date", date_from), _to("transaction_date", date_to))
    found = _where(predictions, _eq("prediction_type", prediction_type)).join(t.select("trade_id"), "trade_id")
    return page(found, [F.desc("created_at"), "prediction_id"], limit, offset)


def trade_predictions(predictions: DataFrame, trade_id: int) -> DataFrame:
    """All predictions of one trade, by type."""
    return predictions.filter(F.col("trade_id") == trade_id).orderBy("prediction_type", "prediction_id")


def model_performance(artifacts: DataFrame) -> DataFrame:
    """Active model versions and their metrics."""
    return artifacts.filter("is_active").orderBy("model_name", "artifact_id")


def list_signals(
    signals: DataFrame, signal_type: str | None = None, ticker: str | None = None, member: str | None = None,
    min_strength: float | None = None, active_only: bool = True, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Signals by type, ticker, member and strength, strongest first."""
    found = _where(
        signals, F.col("is_active") if active_only else None, _eq("signal_type", signal_type), _eq("ticker", ticker),
        _eq("member_bioguide_id", member), _from("strength", min_strength))
    return page(found, [F.desc("strength"), F.desc("created_at"), "signal_id"], limit, offset)


def unscored_trades(trades: DataFrame, predictions: DataFrame, limit: int | None = None) -> DataFrame:
    """Trades with a ticker and without any prediction, newest first."""
    found = trades.filter("ticker is not null").join(predictions.select("trade_id"), "trade_id", "left_anti")
    return page(found, [F.desc("transaction_date"), "trade_id"], limit)


def unanalysed_media(media: DataFrame, sentiment: DataFrame, model: str) -> DataFrame:
    """Media with content that a model has not analysed yet."""
    done = sentiment.filter(F.col("model_name") == model).select("media_id")
    return media.filter("content is not null and content <> ''").join(done, "media_id", "left_anti")


def trading_members(members: DataFrame, trades: DataFrame) -> DataFrame:
    """Members with at least one trade."""
    return members.join(trades.select(F.col("member_bioguide_id").alias("bioguide_id")), "bioguide_id", "left_semi")


# --- set operations --------------------------------------------------------------


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def unique_tickers(trades: DataFrame) -> DataFrame:
    return trades.filter("ticker is not null").select("ticker").distinct()


def known_tickers(prices: DataFrame, trades: DataFrame) -> DataFrame:
    """Tickers with prices or with trades."""
    return prices.select("ticker").union(unique_tickers(trades)).distinct()


def tickers_without_sector(trades: DataFrame, sectors: DataFrame) -> DataFrame:
    return unique_tickers(trades).subtract(sectors.select("ticker"))
