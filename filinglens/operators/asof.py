"""As-of and forward-offset lookups of a daily series.

Many left rows share a (key, day). The lookup therefore runs on the *distinct*
(key, day) pairs and is joined back with a plain equi-join: the ordered window
sees at most one row per key and calendar day from either side, however many
trades a hot key has, and the join key is fine enough for AQE to split skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

FIRST_DAY = "0001-01-01"


def key_days(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Distinct non-null (keys, day) pairs as (keys, _day)."""
    return df.select(*keys, F.col(day).alias("_day")).dropna().distinct()


def join_days(left: DataFrame, looked: DataFrame, keys: Sequence[str], day: str, how: str = "left") -> DataFrame:
    """Join a per-(keys, _day) result back to the rows it was derived from.

    Without keys the result has a row per calendar day at most and is broadcast:
    the rows stay where they are.
    """
    right = looked.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in looked.columns if c not in keys])
    on = F.col(day) == F.col("_day")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return left.join(right if keys else F.broadcast(right), on, how).drop("_day", *[f"_k_{k}" for k in keys])


def last_known(
    grid: DataFrame, series: DataFrame, keys: Sequence[str], series_day: str, columns: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """For each (keys, _day) of the grid, the last series row up to that day.

    The series is unique per (keys, day). ``strict`` looks at days before only.
    """
    rows = series.select(*keys, F.col(series_day).alias("_day"), F.struct(*columns).alias("_row"))
    row_type = rows.schema["_row"].dataType
    asked = grid.withColumn("_row", F.lit(None).cast(row_type)).withColumn("_ask", F.lit(0 if strict else 1))
    both = rows.withColumn("_ask", F.lit(1 if strict else 0)).unionByName(asked)
    w = Window.partitionBy(*keys).orderBy("_day", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("_last", F.last("_row", ignorenulls=True).over(w))
        .filter(F.col("_ask") == (0 if strict else 1))
        .select(*keys, "_day", "_last.*")
    )


def asof_price(trades: DataFrame, prices: DataFrame, price: str = "adj_close", strict: bool = False) -> DataFrame:
    """Adds base_price and base_date: the last price on or before the trade date."""
    series = prices.select("ticker", "date", F.col(price).alias("base_price"), F.col("date").alias("base_date"))
    grid = key_days(trades, ["ticker"], "transaction_date")
    looked = last_known(grid, series, ["ticker"], "date", ["base_price", "base_date"], strict)
    return join_days(trades, looked, ["ticker"], "transaction_date")


def price_points(trades: DataFrame, prices: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """Adds the base price and, per name, the (k+1)-th price row after the trade.

    ``offsets`` maps a name to k; the columns are price_<name> and date_<name>.
    A start-of-time row per ticker makes trades before the first price count
    forward from the beginning of the series.
    """
    start = prices.select("ticker").distinct().select(
        "ticker", F.lit(FIRST_DAY).cast("date").alias("date"), F.lit(None).cast("double").alias("price"))
    series = prices.select("ticker", "date", F.col("adj_close").cast("double").alias("price")).unionByName(start)
    w = Window.partitionBy("ticker").orderBy("date")
    columns = ["base_price", "base_date"]
    series = series.withColumn("base_price", F.col("price")).withColumn(
        "base_date", F.when(F.col("date") > F.lit(FIRST_DAY).cast("date"), F.col("date")))
    for name, k in offsets.items():
        series = series.withColumn(f"price_{name}", F.lead("price", k + 1).over(w)).withColumn(
            f"date_{name}", F.lead("date", k + 1).over(w))
        columns += [f"price_{name}", f"date_{name}"]
    looked = last_known(key_days(trades, ["ticker"], "transaction_date"), series, ["ticker"], "date", columns)
    return join_days(trades, looked, ["ticker"], "transaction_date")


def nth_price_after(trades: DataFrame, prices: DataFrame, k: int) -> DataFrame:
    """Adds price_future and future_date: the (k+1)-th price row strictly after the trade."""
    return (
        price_points(trades, prices, {"future": k})
        .withColumnRenamed("date_future", "future_date")
    )


def _ratio(future, base):
    return F.when((base != 0) & (future != 0), (future - base) / base)


def forward_return_capped(trades: DataFrame, prices: DataFrame, n: int) -> DataFrame:
    """Adds actual_return_<n>d: n-th row after the trade, or the last row in 1.5n days."""
    cap = int(n * 1.5)
    points = price_points(trades, prices, {"nth": n - 1})
    at_cap = prices.select(
        "ticker", "date", F.col("adj_close").cast("double").alias("cap_price"), F.col("date").alias("cap_date"))
    points = points.withColumn("_cap_day", F.date_add("transaction_date", cap))
    looked = last_known(key_days(points, ["ticker"], "_cap_day"), at_cap, ["ticker"], "date", ["cap_price", "cap_date"])
    points = join_days(points, looked, ["ticker"], "_cap_day")
    target = F.when(F.col("date_nth") <= F.col("_cap_day"), F.col("price_nth")).when(
        F.col("cap_date") > F.col("transaction_date"), F.col("cap_price"))
    return points.withColumn(f"actual_return_{n}d", _ratio(target, F.col("base_price"))).drop(
        "_cap_day", "cap_price", "cap_date", "price_nth", "date_nth")


def backfill_returns(predictions: DataFrame, trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Fills missing realised returns of predictions (5 rows in 8 days, 21 in 32)."""
    points = price_points(
        trades.select("trade_id", "ticker", "transaction_date"), prices, {"r5": 4, "r21": 20})

    def realised(name: str, days: int):
        soon = F.datediff(f"date_{name}", "transaction_date") <= days
        return F.when(soon, _ratio(F.col(f"price_{name}"), F.col("base_price")))

    new = points.select(
        "trade_id", realised("r5", 8).alias("_new_5d"), realised("r21", 32).alias("_new_21d"))
    open_row = F.col("actual_return_5d").isNull()
    return (
        predictions.join(new, "trade_id", "left")
        .withColumn("actual_return_21d", F.coalesce("actual_return_21d", F.when(open_row, F.col("_new_21d"))))
        .withColumn("actual_return_5d", F.coalesce("actual_return_5d", "_new_5d"))
        .drop("_new_5d", "_new_21d")
    )
