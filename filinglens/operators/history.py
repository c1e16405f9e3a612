"""Features from other trades, other members and the news around a trade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import join_days, key_days, price_points
from .dayrange import day_totals
from .ordinal import running_before


def member_history(trades: DataFrame, prices: DataFrame, horizon_rows: int = 20) -> DataFrame:
    """Win rate, number and mean return of the member's earlier trades.

    One row per trade of a named member with a positive base price. Outcomes of
    all earlier trades count, known by then or not; a win is a return whose sign
    agrees with the direction. Fewer than three outcomes give 0.5 / 0 / 0.
    """
    points = price_points(
        trades.filter("member_bioguide_id is not null and ticker is not null and ticker <> ''"),
        prices, {"future": horizon_rows},
    ).filter("base_price > 0")
    ret = (F.col("price_future") - F.col("base_price")) / F.col("base_price")
    won = (ret > 0) == F.coalesce(F.col("transaction_type") == "purchase", F.lit(False))
    outcomes = points.select(
        "trade_id", "member_bioguide_id", "transaction_date",
        F.when(ret.isNotNull(), 1).otherwise(0).alias("total"),
        F.when(ret.isNotNull() & won, 1).otherwise(0).alias("wins"),
        F.coalesce(ret, F.lit(0.0)).alias("ret"),
    )
    run = running_before(
        outcomes, ["member_bioguide_id"], "transaction_date", "trade_id", ["total", "wins", "ret"])
    n = F.col("before_total")
    return run.select(
        "trade_id",
        F.when(n >= 3, F.col("before_wins") / n).otherwise(0.5).alias("member_win_rate"),
        F.when(n >= 3, n.cast("double")).otherwise(0.0).alias("member_trade_count"),
        F.when(n >= 3, F.col("before_ret") / n).otherwise(0.0).alias("member_avg_return"),
    )


def _members_around(trades: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Distinct members trading within ``days`` of each (keys, day) that occurs.

    Each member's days are turned into disjoint stretches of days they cover;
    a running sum of stretch starts and ends per calendar day is the distinct
    count. No pair of trades is ever formed.
    """
    active = trades.select(
        *keys, F.coalesce("member_bioguide_id", F.lit("")).alias("m"), F.unix_date("transaction_date").alias("d")
    ).distinct()
    prev = F.lag("d").over(Window.partitionBy(*keys, "m").orderBy("d"))
    start = F.greatest(F.col("d") - days, prev + days + 1)
    stretches = active.withColumn("start", start).select(
        *keys,
        F.explode(F.array(
            F.struct(F.col("start").alias("day"), F.lit(1).alias("step")),
            F.struct((F.col("d") + days + 1).alias("day"), F.lit(-1).alias("step")),
        )).alias("e"))
    steps = stretches.groupBy(*keys, F.col("e.day").alias("day")).agg(F.sum("e.step").alias("step"))
    asked = active.select(*keys, F.col("d").alias("day")).distinct()
    both = steps.withColumn("ask", F.lit(False)).unionByName(
        asked.withColumn("step", F.lit(0).cast("long")).withColumn("ask", F.lit(True)))
    upto = Window.partitionBy(*keys).orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("members", F.sum("step").over(upto)).filter("ask")
        .select(*keys, F.date_from_unix_date("day").alias("_day"), "members")
    )


def cross_member(trades: DataFrame) -> DataFrame:
    """Other members in the same ticker within 7 and 30 days, and same direction.

    A missing member counts as one more (unnamed) member. The trade's own member
    is always among the distinct members of its window, hence the minus one.
    """
    from ..functions.features import code
    from .. import constants as K

    t = trades.filter("ticker is not null").select(
        "trade_id", "ticker", "transaction_date", "member_bioguide_id",
        F.coalesce(code("transaction_type", K.DIRECTION_CODES), F.lit(0.0)).alias("direction"))
    out = t
    for name, keys, days in (
        ("cross_member_7d", ["ticker"], 7), ("cross_member_30d", ["ticker"], 30),
        ("cross_member_same_dir_7d", ["ticker", "direction"], 7),
    ):
        around = _members_around(t, keys, days).select(*keys, "_day", (F.col("members") - 1).cast("double").alias(name))
        out = join_days(out, around, keys, "transaction_date")
    return out.select("trade_id", "cross_member_7d", "cross_member_30d", "cross_member_same_dir_7d")


def member_velocity(trades: DataFrame, all_trades: DataFrame | None = None) -> DataFrame:
    """The member's trades in the 30 and 90 days before, and the ratio of rates."""
    source = (trades if all_trades is None else all_trades).filter("member_bioguide_id is not null")
    daily = source.groupBy("member_bioguide_id", F.col("transaction_date").alias("_day")).agg(F.count("*").alias("n"))
    around = day_totals(
        key_days(trades, ["member_bioguide_id"], "transaction_date"), daily, ["member_bioguide_id"],
        {"member_trades_30d": ("n", -30, -1), "member_trades_90d": ("n", -90, -1)})
    rate_30, rate_90 = F.col("member_trades_30d") / 30.0, F.col("member_trades_90d") / 90.0
    ratio = F.when(rate_90 > 0, F.least(rate_30 / rate_90, F.lit(10.0))).otherwise(1.0)
    named = trades.filter("member_bioguide_id is not null").select(
        "trade_id", "member_bioguide_id", "transaction_date")
    return join_days(named, around, ["member_bioguide_id"], "transaction_date").select(
        "trade_id", "member_trades_30d", "member_trades_90d", ratio.alias("member_velocity_ratio"))


def ticker_popularity(trades: DataFrame) -> DataFrame:
    """Distinct members, trades and purchase share of each ticker, all dates."""
    return trades.filter("ticker is not null").groupBy("ticker").agg(
        F.count_distinct("member_bioguide_id").alias("ticker_total_members"),
        F.count("*").alias("ticker_total_trades"),
        F.avg(F.when(F.col("transaction_type") == "purchase", 1.0).otherwise(0.0)).alias("ticker_purchase_ratio"),
    )


def ticker_popularity_before(trades: DataFrame) -> DataFrame:
    """Point-in-time form: the same three figures from strictly earlier days only."""
    t = trades.filter("ticker is not null")
    first_seen = t.filter("member_bioguide_id is not null").groupBy("ticker", "member_bioguide_id").agg(
        F.min("transaction_date").alias("_day"))
    newcomers = first_seen.groupBy("ticker", "_day").agg(F.count("*").alias("newcomers"))
    daily = t.groupBy("ticker", F.col("transaction_date").alias("_day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("transaction_type") == "purchase").alias("bought"))
    past = Window.partitionBy("ticker").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0))
    per_day = daily.join(newcomers, ["ticker", "_day"], "left").select(
        "ticker", "_day", before("newcomers").alias("ticker_total_members"), before("n").alias("ticker_total_trades"),
        before("bought").alias("_bought")).withColumn(
        "ticker_purchase_ratio",
        F.when(F.col("ticker_total_trades") > 0, F.col("_bought") / F.col("ticker_total_trades")).otherwise(0.5)
    ).drop("_bought")
    return join_days(t.select("trade_id", "ticker", "transaction_date"), per_day, ["ticker"], "transaction_date").drop(
        "ticker", "transaction_date")


def daily_sentiment(media: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Mean score and number of analyses per publication day."""
    return (
        sentiment.select("media_id", "sentiment_score")
        .join(media.select("media_id", "published_date"), "media_id")
        .filter("published_date is not null")
        .groupBy("published_date")
        .agg(F.avg("sentiment_score").alias("avg_score"), F.count("*").alias("article_count"))
    )


def sentiment_windows(trades: DataFrame, daily: DataFrame) -> DataFrame:
    """Mean of daily means and article counts over [d-7, d) and [d-30, d)."""
    rows = daily.select(
        F.lit(0).alias("_all"), F.col("published_date").alias("_day"), "avg_score", "article_count",
        F.lit(1).alias("one"))
    grid = key_days(trades, [], "transaction_date").select(F.lit(0).alias("_all"), "_day")
    around = day_totals(grid, rows, ["_all"], {
        f"{name}_{n}": (column, -n, -1)
        for n in (7, 30) for name, column in (("score", "avg_score"), ("days", "one"), ("articles", "article_count"))
    })
    mean = lambda n: F.when(F.col(f"days_{n}") > 0, F.col(f"score_{n}") / F.col(f"days_{n}")).otherwise(0.0)
    per_day = around.select(
        "_day", mean(7).alias("avg_sentiment_7d"), mean(30).alias("avg_sentiment_30d"),
        (mean(7) - mean(30)).alias("sentiment_momentum"),
        F.col("articles_7").alias("media_mention_count_7d"), F.col("articles_30").alias("media_mention_count_30d"))
    return join_days(trades, per_day, [], "transaction_date")


def sentiment_by_row(trades: DataFrame, media: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Row-weighted form: mean over analyses, counts over contents left-joined.

    Trades with neither member nor ticker keep the zero defaults.
    """
    daily = (
        media.select("media_id", "published_date").filter("published_date is not null")
        .join(sentiment.select("media_id", "sentiment_score"), "media_id", "left")
        .groupBy(F.col("published_date").alias("_day"))
        .agg(F.sum("sentiment_score").alias("score"), F.count("sentiment_score").alias("scored"),
             F.count("*").alias("contents"))
        .withColumn("_all", F.lit(0))
    )
    grid = key_days(trades, [], "transaction_date").select(F.lit(0).alias("_all"), "_day")
    around = day_totals(grid, daily, ["_all"], {
        f"{c}_{n}": (c, -n, -1) for n in (7, 30) for c in ("score", "scored", "contents")})
    mean = lambda n: F.when(F.col(f"scored_{n}") > 0, F.col(f"score_{n}") / F.col(f"scored_{n}")).otherwise(0.0)
    per_day = around.select(
        "_day", mean(7).alias("avg_sentiment_7d"), mean(30).alias("avg_sentiment_30d"),
        (mean(7) - mean(30)).alias("sentiment_momentum"),
        F.col("contents_7").alias("media_mention_count_7d"), F.col("contents_30").alias("media_mention_count_30d"))
    joined = join_days(trades, per_day, [], "transaction_date")
    named = F.col("member_bioguide_id").isNotNull() | F.col("ticker").isNotNull()
    names = [c for c in per_day.columns if c != "_day"]
    return joined.withColumns({c: F.when(named, F.col(c)).otherwise(0.0) for c in names})


def sample_weights(trades: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """log1p of the amount (at least 1000), relative to its mean over all rows, or those of ``over``."""
    from ..functions.features import amount_midpoint

    weight: Column = F.log1p(F.greatest(amount_midpoint(), F.lit(1000.0)))
    weighed = trades.withColumn("_w", weight)
    mean = (weighed if over is None else over.withColumn("_w", weight)).agg(F.avg("_w").alias("_mean"))
    return weighed.crossJoin(F.broadcast(mean)).withColumn(
        "sample_weight", F.col("_w") / F.col("_mean")).drop("_w", "_mean")
