"""Exact running totals and row positions that survive hot keys.

A window over all rows of a hot key would be one task. Both helpers cut a
partition into pieces (days, or value ranges of equal size), total the pieces,
run the window over the few piece totals, and finish inside each piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import join_days


def running_before(
    df: DataFrame, keys: Sequence[str], day: str, tie: str, columns: Sequence[str],
) -> DataFrame:
    """Adds before_<c>: the sum of each column over strictly earlier rows.

    Earlier means by (day, tie) within the keys. Day totals carry the running
    sum (one row per key and day); only rows of one day meet in a window.
    """
    daily = df.groupBy(*keys, F.col(day).alias("_day")).agg(*[F.sum(c).alias(c) for c in columns])
    past = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = daily.select(
        *keys, "_day", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"_past_{c}") for c in columns])
    today = Window.partitionBy(*keys, day).orderBy(tie).rowsBetween(Window.unboundedPreceding, -1)
    out = join_days(df, carried, keys, day)
    for c in columns:
        within = F.coalesce(F.sum(c).over(today), F.lit(0))
        out = out.withColumn(f"before_{c}", F.col(f"_past_{c}") + within)
    return out.drop(*[f"_past_{c}" for c in columns])


def value_ranges(df: DataFrame, column: str, pieces: int = 64) -> list[float]:
    """At most pieces-1 inner boundaries that cut the column into like-sized ranges."""
    steps = [i / pieces for i in range(1, pieces)]
    cuts = df.agg(F.percentile_approx(column, steps, 10000)).first()[0]
    return sorted(set(cuts or []))


def range_number(column: str, cuts: list[float]) -> Column:
    """Number of boundaries below the value: an order-preserving piece number."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c) for c in cuts])
    return F.size(F.filter(table, lambda c: c < F.col(column)))


def day_starts(df: DataFrame, day: str) -> DataFrame:
    """(day, _dn, _day_start): the rows of each day and of all before it, those without a day first; a row per day."""
    days = df.groupBy(day).agg(F.count("*").alias("_dn"))
    earlier = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("_day_start", F.coalesce(F.sum("_dn").over(earlier), F.lit(0)))


def cut_positions(df: DataFrame, day: str, tie: str, days: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """Adds _pos, which compares with each of the cuts as the row's position in (day, tie) order does.

    Only the days that a cut splits are ordered inside; all rows of another day get
    the day's first position and stay where they are. ``days`` are the day_starts.
    """
    start, split = F.col("_day_start"), F.lit(False)
    for c in cuts:
        split = split | ((start < c) & (start + F.col("_dn") > c))
    split_days = [r[day] for r in days.filter(split & F.col(day).isNotNull()).select(day).collect()]  # a day per cut at most
    out = df.join(F.broadcast(days.select(day, start.alias("_pos"))), day)  # a row per calendar day
    if not split_days:
        return out
    inside = F.col(day).isin(split_days)
    return out.filter(~inside).unionByName(row_positions(df.filter(inside), day, tie, days))


def row_positions(df: DataFrame, day: str, tie: str, days: DataFrame | None = None) -> DataFrame:
    """Adds _pos: the 0-based position of each row in (day, tie) order over all rows.

    With the ``days`` of a larger table, of which ``df`` has whole days, it is the position there.
    """
    piece = df.withColumn("_piece", range_number(tie, value_ranges(df, tie)))
    counts = piece.groupBy(day, "_piece").agg(F.count("*").alias("_n"))
    days = day_starts(df, day) if days is None else days
    same_day = Window.partitionBy(day).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(days, day).select(
        day, "_piece",
        (F.col("_day_start") + F.coalesce(F.sum("_n").over(same_day), F.lit(0))).alias("_start"))
    inside = Window.partitionBy(day, "_piece").orderBy(tie)
    return (
        piece.join(starts, [day, "_piece"])
        .withColumn("_pos", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_piece", "_start")
    )


def cumulative_by_value(counts: DataFrame, value: str, columns: Sequence[str], pieces: int = 64) -> DataFrame:
    """Adds below_<c>: the total of each column over rows with a smaller value.

    ``counts`` has one row per distinct value.
    """
    piece = counts.withColumn("_piece", range_number(value, value_ranges(counts, value, pieces)))
    totals = piece.groupBy("_piece").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_piece", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_s_{c}") for c in columns])
    inside = Window.partitionBy("_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = piece.join(starts, "_piece")
    for c in columns:
        out = out.withColumn(f"below_{c}", F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_piece", *[f"_s_{c}" for c in columns])


__all__ = ["running_before", "value_ranges", "range_number", "day_starts", "cut_positions", "row_positions", "cumulative_by_value"]
