"""Feature and score expressions over columns of one row."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, functions as F

from .. import constants as K


def code(c: Column | str, table: dict[str, int]) -> Column:
    """Look a string up in a small fixed code table (null when absent)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.create_map(*[F.lit(v) for item in table.items() for v in item])[c].cast("double")


def _d(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def amount_midpoint() -> Column:
    return (_d("amount_range_low") + _d("amount_range_high")) / 2


def disclosure_lag(floor: bool = True) -> Column:
    lag = F.datediff("disclosure_date", "transaction_date").cast("double")
    if floor:
        lag = F.greatest(lag, F.when(lag.isNotNull(), F.lit(0.0)))
    return F.coalesce(lag, F.lit(30.0))


def trade_features(floor: bool = True) -> dict[str, Column]:
    """Amount, direction, filer and disclosure-lag columns of a trade."""
    return {
        "amount_midpoint": amount_midpoint(),
        "amount_log": F.log1p(amount_midpoint()),
        "is_purchase": (F.coalesce(F.col("transaction_type"), F.lit("")) == "purchase").cast("double"),
        "tx_direction": F.coalesce(code("transaction_type", K.DIRECTION_CODES), F.lit(0.0)),
        "filer_type_encoded": F.coalesce(code("filer_type", K.FILER_TYPE_CODES), F.lit(0.0)),
        "disclosure_lag_days": disclosure_lag(floor),
    }


def member_features(as_of: date) -> dict[str, Column]:
    """Party, chamber, ideology and tenure.

    Both spellings of the first party are accepted. A missing first election
    counts as ten years in office.
    """
    return {
        "party_encoded": F.coalesce(code("party", K.PARTY_CODES), F.lit(2.0)),
        "chamber_encoded": F.coalesce(
            code("member_chamber", K.CHAMBER_CODES), code("trade_chamber", K.CHAMBER_CODES), F.lit(0.0)
        ),
        "nominate_dim1": _d("nominate_dim1"),
        "nominate_dim2": _d("nominate_dim2"),
        "years_in_office": F.coalesce(F.lit(as_of.year) - F.col("first_elected"), F.lit(10)).cast("double"),
    }


def labels() -> dict[str, Column]:
    """Return, direction-adjusted return and the thresholded label."""
    base, future = F.col("base_price").cast("double"), F.col("price_future").cast("double")
    actual = F.when(base > 0, (future - base) / base)
    directional = F.when(F.col("transaction_type") == "purchase", actual).otherwise(-actual)
    return {
        "actual_return": actual,
        "directional_return": directional,
        "profitable": (directional > K.PROFIT_THRESHOLD).cast("double"),
    }


def sign_label(ret: Column | str) -> Column:
    """1 when the sign of the return agrees with the direction, else 0."""
    ret = F.col(ret) if isinstance(ret, str) else ret
    bought = F.coalesce(F.col("transaction_type") == "purchase", F.lit(False))
    return ((ret > 0) == bought).cast("int")


def calendar_features(day: Column | str = "transaction_date") -> dict[str, Column]:
    """Seasonal and political-cycle columns of a date."""
    d = F.col(day) if isinstance(day, str) else day
    month, year = F.month(d), F.year(d)
    return {
        "month_sin": F.sin(2 * math.pi * month / 12),
        "month_cos": F.cos(2 * math.pi * month / 12),
        "quarter": F.quarter(d).cast("double"),
        "day_of_week": F.weekday(d).cast("double"),
        "is_december": (month == 12).cast("double"),
        "is_january": (month == 1).cast("double"),
        "is_election_year": year.isin(K.ELECTION_YEARS).cast("double"),
        "is_midterm_year": year.isin(K.MIDTERM_YEARS).cast("double"),
        "days_to_election": days_to_election(d),
        "is_lame_duck": ((month >= 11) | (month == 1)).cast("double"),
    }


def days_to_election(day: Column | str = "transaction_date") -> Column:
    """Days to the next 5 November, within 0..730."""
    d = F.col(day) if isinstance(day, str) else day
    this_year = F.datediff(F.make_date(F.year(d), F.lit(11), F.lit(5)), d)
    next_year = F.datediff(F.make_date(F.year(d) + 1, F.lit(11), F.lit(5)), d)
    days = F.when(this_year < 0, next_year).otherwise(this_year)
    return F.least(F.greatest(days, F.lit(0)), F.lit(730)).cast("double")


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def timing_score() -> Column:
    """Weighted linear decays of legislative distance, lag and sponsorship."""
    hearing = _unit(1.0 - F.col("min_hearing_distance") / 30.0)
    bill = _unit(1.0 - F.col("min_bill_distance") / 90.0)
    lag = _unit(F.col("disclosure_lag_days") / 90.0)
    sponsor = F.when(F.col("sponsored_bill_near_trade") > 0, 0.15).otherwise(0.0)
    return _unit(hearing * 0.35 + bill * 0.25 + lag * 0.25 + sponsor)


def suspicion_score() -> Column:
    """Stepped heuristic over a legislative context row, capped at 1."""
    hearing, bill, lag = (
        F.col("min_hearing_distance_days"), F.col("min_bill_distance_days"), F.col("disclosure_lag_days"),
    )
    total = (
        F.when(hearing <= 3, 0.3).when(hearing <= 7, 0.2).when(hearing <= 14, 0.1).otherwise(0.0)
        + F.when(bill <= 7, 0.2).when(bill <= 30, 0.1).otherwise(0.0)
        + F.when(F.col("committee_sector_alignment"), 0.2).otherwise(0.0)
        + F.when(lag > 40, 0.15).when(lag > 30, 0.05).otherwise(0.0)
        + F.when(F.col("has_sponsored_bill"), 0.15).otherwise(0.0)
    )
    return F.least(total, F.lit(1.0))


def interactions() -> dict[str, Column]:
    """Ten products and ratios of already computed features."""
    direction, amount = F.col("tx_direction"), F.col("amount_log")
    return {
        "dir_x_bull": direction * F.col("market_is_bull"),
        "dir_x_win_rate": direction * F.col("member_win_rate"),
        "dir_x_rsi": direction * F.col("rsi_14"),
        "dir_x_momentum_21d": direction * F.col("price_change_21d"),
        "dir_x_52w_pos": direction * F.col("high_52w_position"),
        "amt_x_near_bill": amount * (F.col("min_bill_distance") < 90).cast("double"),
        "amt_x_near_hearing": amount * (F.col("min_hearing_distance") < 30).cast("double"),
        "win_rate_x_amount": F.col("member_win_rate") * amount,
        "dir_x_cluster_7d": direction * F.col("cross_member_same_dir_7d"),
        "sharpe_21d": F.col("price_change_21d") / F.greatest(F.col("volatility_21d"), F.lit(0.001)),
    }


def excess_return() -> Column:
    return F.col("price_change_21d") - F.col("spy_return_21d")


def network_features(record: str = "network") -> dict[str, Column]:
    """Four columns from a nested network record (null record = zeros)."""
    field = lambda name: F.col(f"{record}.{name}")
    flag = lambda name: F.coalesce(field(name), F.lit(False)).cast("double")
    return {
        "lobbying_connection_count": F.coalesce(field("lobbying_connections"), F.lit(0)).cast("double"),
        "campaign_donor_connection": flag("has_campaign_donor"),
        "network_degree": F.coalesce(field("degree"), F.lit(0)).cast("double"),
        "has_lobbying_triangle": flag("has_suspicious_triangle"),
    }


# --- signal and screening scores ------------------------------------------------


def signal_scores() -> dict[str, Column]:
    """Strength and confidence from base confidence, lag and evidence kinds.

    A lag under a week earns the bonus before the lag penalty is applied; a
    negative lag earns the bonus only.
    """
    base = F.coalesce(F.col("confidence").cast("double"), F.lit(0.5))
    lag = F.col("disclosure_lag_days")
    fresh = base + F.when(lag < 7, 0.1).otherwise(0.0)
    decayed = F.when(lag > 0, fresh * F.greatest(F.lit(0.3), 1.0 - lag / 45.0)).otherwise(fresh)
    kinds = sum(
        F.col(f"evidence.{field}").isNotNull().cast("int")
        for field in (
            "trade_id", "prediction_id", "anomaly_score", "avg_sentiment_30d", "cluster_size", "lobbying_amount",
        )
    )
    size = F.col("evidence.cluster_size")
    cluster = F.when(
        F.col("signal_type") == "insider_cluster", F.when(size >= 5, 0.2).when(size >= 3, 0.1).otherwise(0.0)
    ).otherwise(0.0)
    strength = decayed + F.greatest(F.lit(0), kinds - 1) * 0.15 + cluster
    return {
        "strength": F.round(F.least(strength, F.lit(1.0)), 4),
        "confidence": F.round(F.least(base, F.lit(1.0)), 4),
    }


def composite_score() -> Column:
    """Weighted ticker score in 0..1."""
    return _unit(
        0.30 * F.col("avg_strength") + 0.25 * F.col("ml_confidence") + 0.20 * F.col("best_win_rate")
        + 0.15 * F.col("freshness") + 0.10 * F.col("count_bonus")
    )


def freshness(created_at: Column | str, as_of: Column) -> Column:
    """1 for a brand-new signal, 0 from seven days on."""
    created = F.col(created_at) if isinstance(created_at, str) else created_at
    hours = (F.unix_micros(as_of) - F.unix_micros(created)) / 3.6e9
    return _unit(1.0 - hours / 168.0)


def count_bonus(n: Column) -> Column:
    return F.least(n / 5.0, F.lit(1.0))
