"""Technical indicators over daily prices.

Computed once per (ticker, date) price row with ROWS frames and attached to
trades by a strict as-of lookup. Prices are unique per ticker and day, so a
ticker's window is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import join_days, key_days, last_known

DEFAULTS = {
    "price_change_5d": 0.0, "price_change_21d": 0.0, "volatility_21d": 0.0, "volume_ratio_5d": 0.0,
    "rsi_14": 50.0, "macd_signal": 0.0, "bollinger_position": 0.5, "ma_cross_50_200": 0.0,
    "high_52w_position": 0.5,
}


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def _frame(n: int):
    """The last n rows up to the current one."""
    return by_ticker().rowsBetween(1 - n, 0)


def _rows(n: int) -> Column:
    return F.count("*").over(_frame(n))


def prepare(prices: DataFrame) -> DataFrame:
    """Price, volume, one-row change and one-row return of every row."""
    price = F.coalesce(F.col("adj_close"), F.col("close")).cast("double")
    base = prices.select(
        "ticker", "date", price.alias("price"), F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume")
    ).filter("price is not null")
    prev = F.lag("price").over(by_ticker())
    return base.withColumn("chg", F.col("price") - prev).withColumn(
        "ret", F.when(prev > 0, (F.col("price") - prev) / prev))


def price_change(n: int) -> Column:
    """Change against n rows ago, or the oldest of the last 30 rows."""
    then = F.coalesce(F.lag("price", n).over(by_ticker()), F.first("price").over(_frame(30)))
    now = F.when(F.col("price") > 0, F.col("price")).otherwise(1.0)
    return F.when(_rows(2) < 2, 0.0).when(then > 0, (now - then) / then).otherwise(0.0)


def volatility(n: int = 21) -> Column:
    """Sample deviation of the last n returns within the last 30 rows."""
    enough = F.count("ret").over(_frame(n)) >= 2
    return F.when(enough, F.stddev_samp("ret").over(_frame(n))).otherwise(0.0)


def volume_ratio() -> Column:
    """Mean volume of 5 rows over that of 21."""
    short, long = F.avg("volume").over(_frame(5)), F.avg("volume").over(_frame(21))
    return F.when(_rows(2) < 2, 0.0).when(long > 0, short / long).otherwise(1.0)


def rsi(n: int = 14) -> Column:
    """Relative strength from simple means of the last n changes."""
    gain = F.avg(F.greatest(F.col("chg"), F.lit(0.0)) + F.col("chg") * 0).over(_frame(n))
    loss = F.avg(F.greatest(-F.col("chg"), F.lit(0.0)) + F.col("chg") * 0).over(_frame(n))
    return F.when(_rows(2) < 2, 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))


def with_ema(df: DataFrame, *spans: int, length: int = 260) -> DataFrame:
    """Adds ema_<span>: exponential mean over up to ``length`` rows, oldest as seed.

    The recurrence is unrolled into weighted sums. Rows are cut into blocks of
    ``length``; a frame is the head of its own block plus the tail of the one
    before, so two running sums per block give every frame at constant cost and
    the weights stay within one block's range.
    """
    df = df.withColumn("_n", F.row_number().over(by_ticker()) - 1).withColumn(
        "_block", F.floor(F.col("_n") / length)).withColumn("_off", F.col("_n") % length)
    head = Window.partitionBy("ticker", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({
        f"_c{s}": F.sum(F.col("price") * (2.0 / (s + 1)) * F.pow(F.lit(1 - 2.0 / (s + 1)), -F.col("_off"))).over(head)
        for s in spans})
    df = df.withColumns({
        **{f"_b{s}": F.lag(f"_c{s}", 1).over(by_ticker()) for s in spans},
        **{f"_p{s}": F.lag(f"_c{s}", length).over(by_ticker()) for s in spans},
        "_oldest": F.first("price").over(_frame(length))})
    df = df.withColumns({f"_t{s}": F.first(f"_b{s}").over(head) for s in spans})

    def mean(s: int) -> Column:
        q = F.lit(1 - 2.0 / (s + 1))
        tail = F.coalesce(F.col(f"_t{s}") - F.col(f"_p{s}"), F.lit(0.0))
        return (
            F.pow(q, F.col("_off")) * F.col(f"_c{s}") + F.pow(q, F.col("_off") + length) * tail
            + F.pow(q, F.least(F.col("_n") + 1, F.lit(length))) * F.col("_oldest"))

    df = df.withColumns({f"ema_{s}": mean(s) for s in spans})
    return df.drop(*[f"_{k}{s}" for s in spans for k in "cbpt"], "_n", "_block", "_off", "_oldest")


def macd() -> Column:
    """Twelve-row minus 26-row exponential mean; 0 below 26 rows."""
    return F.when(_rows(26) >= 26, F.col("ema_12") - F.col("ema_26")).otherwise(0.0)


def bollinger() -> Column:
    """Position between the 20-row bands of two sample deviations."""
    mean, dev = F.avg("price").over(_frame(20)), F.stddev_samp("price").over(_frame(20))
    inside = (F.col("price") - (mean - 2 * dev)) / (4 * dev)
    return F.when((_rows(26) >= 26) & (dev > 0), inside).otherwise(0.5)


def ma_cross() -> Column:
    """+1 / -1 as the 50-row mean is above the 200-row mean or not."""
    above = F.avg("price").over(_frame(50)) > F.avg("price").over(_frame(200))
    return F.when(_rows(200) < 200, 0.0).when(above, 1.0).otherwise(-1.0)


def range_position() -> Column:
    """Position between the low and the high of 252 rows."""
    high, low = F.max("price").over(_frame(252)), F.min("price").over(_frame(252))
    return F.when((_rows(200) >= 200) & (high > low), (F.col("price") - low) / (high - low)).otherwise(0.5)


def indicator_columns() -> dict[str, Column]:
    return {
        "price_change_5d": price_change(5), "price_change_21d": price_change(21), "volatility_21d": volatility(21),
        "volume_ratio_5d": volume_ratio(), "rsi_14": rsi(14), "macd_signal": macd(),
        "bollinger_position": bollinger(), "ma_cross_50_200": ma_cross(), "high_52w_position": range_position(),
    }


def indicators(prices: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(ticker, date) with the named indicators, the current row included."""
    columns = indicator_columns()
    names = list(names or columns)
    rows = prepare(prices)
    if "macd_signal" in names:
        rows = with_ema(rows, 12, 26)
    return rows.select("ticker", "date", *[columns[n].alias(n) for n in names])


def attach_indicators(trades: DataFrame, prices: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Indicators from the rows strictly before each trade, defaults elsewhere.

    Only price rows that some trade looks back to are needed, but the frames
    need all of them; the semi-join keeps tickers that nobody trades out.
    """
    names = list(names or DEFAULTS)
    grid = key_days(trades, ["ticker"], "transaction_date")
    traded = prices.join(grid.select("ticker").distinct(), "ticker", "left_semi")
    looked = last_known(grid, indicators(traded, names), ["ticker"], "date", names, strict=True)
    joined = join_days(trades, looked, ["ticker"], "transaction_date")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(DEFAULTS[n])) for n in names})


def recent_market_features(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """The five short-window features for scoring: history is the 60 days before.

    Frames end at the row before the trade; rows older than 60 days drop out by
    their date, which only matters where trading was sparse.
    """
    cap = 22
    rows = prepare(prices).withColumn("item", F.struct("date", "price", "volume"))
    rows = rows.withColumn("recent", F.collect_list("item").over(_frame(cap)))
    grid = key_days(trades, ["ticker"], "transaction_date")
    looked = last_known(grid, rows, ["ticker"], "date", ["recent"], strict=True)
    day_floor = F.date_sub("_day", 60)
    recent = F.reverse(F.filter("recent", lambda r: r["date"] >= day_floor))
    looked = looked.withColumn("recent", recent).withColumn("n", F.coalesce(F.size("recent"), F.lit(0)))
    p = lambda i: F.get("recent", F.least(F.lit(i), F.col("n") - 1))["price"]
    now = F.when(p(0) > 0, p(0)).otherwise(1.0)
    change = lambda i: F.when(p(i) > 0, (now - p(i)) / p(i)).otherwise(0.0)
    steps = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(20), F.col("n") - 2)),
        lambda i: F.struct(
            F.get("recent", i)["price"].alias("new"), F.get("recent", i + 1)["price"].alias("old")))
    returns = F.transform(F.filter("steps", lambda s: s["old"] > 0), lambda s: (s["new"] - s["old"]) / s["old"])
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    mean_volume = lambda k: total(F.slice("recent", 1, k), lambda r: r["volume"]) / F.least(F.lit(k), F.col("n"))
    out = (
        looked.filter("n >= 2")
        .withColumn("steps", steps)
        .withColumn("returns", returns)
        .withColumn("mean_ret", total("returns", lambda r: r) / F.size("returns"))
        .withColumn("sq", total("returns", lambda r: (r - F.col("mean_ret")) * (r - F.col("mean_ret"))))
        .withColumn("gain", total(F.slice("steps", 1, 14), lambda s: F.greatest(s["new"] - s["old"], F.lit(0.0))))
        .withColumn("loss", total(F.slice("steps", 1, 14), lambda s: F.greatest(s["old"] - s["new"], F.lit(0.0))))
        .select(
            "ticker", "_day", change(5).alias("price_change_5d"), change(21).alias("price_change_21d"),
            F.when(F.size("returns") >= 2, F.sqrt(F.col("sq") / (F.size("returns") - 1))).otherwise(0.0)
            .alias("volatility_21d"),
            F.when(mean_volume(21) > 0, mean_volume(5) / mean_volume(21)).otherwise(1.0).alias("volume_ratio_5d"),
            F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss")))
            .alias("rsi_14"),
        )
    )
    names = list(DEFAULTS)[:5]
    joined = join_days(trades, out, ["ticker"], "transaction_date")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(DEFAULTS[n])) for n in names})


def market_regime(trades: DataFrame, benchmark: DataFrame) -> DataFrame:
    """State of the benchmark before each trade: returns, volatility, bull flag.

    ``benchmark`` holds (date, adj_close) of one index; its 21-row return looks
    back 20 rows. Fewer than five rows before the trade give zeros.
    """
    everywhere = benchmark.select(
        F.lit("*").alias("ticker"), "date", F.col("adj_close").cast("double").alias("price"))
    prev = F.lag("price").over(by_ticker())
    rows = everywhere.withColumn("ret", F.when(prev != 0, (F.col("price") - prev) / prev))
    n = _rows(63)
    p21 = F.coalesce(F.lag("price", 20).over(by_ticker()), F.first("price").over(_frame(63)))
    p63 = F.when(n >= 21, F.first("price").over(_frame(63))).otherwise(p21)
    change = lambda then: F.when(then > 0, (F.col("price") - then) / then).otherwise(0.0)
    rows = rows.select(
        "ticker", "date", n.alias("n"),
        change(p21).alias("spy_return_21d"), change(p63).alias("spy_return_63d"),
        F.when(n >= 22, F.stddev_samp("ret").over(_frame(21))).otherwise(0.0).alias("spy_volatility_21d"),
        (F.col("price") > F.avg("price").over(_frame(63))).cast("double").alias("market_is_bull"),
    )
    names = ["spy_return_21d", "spy_return_63d", "spy_volatility_21d", "market_is_bull"]
    grid = key_days(trades, [], "transaction_date").withColumn("ticker", F.lit("*"))
    looked = last_known(grid, rows, ["ticker"], "date", ["n", *names], strict=True)
    looked = looked.select("_day", *[F.when(F.col("n") >= 5, F.col(c)).otherwise(0.0).alias(c) for c in names])
    joined = join_days(trades, looked, [], "transaction_date")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names})


def risk_metrics(prices: DataFrame) -> DataFrame:
    """Per ticker, from its last 30 closes: change, yearly volatility and RSI.

    The newest 30 rows per ticker are kept by a top-n window, then reduced with
    ordinary aggregates. RSI here works on returns, not on price changes.
    """
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    last = (
        prices.select("ticker", "date", F.col("close").cast("double").alias("close"))
        .withColumn("_age", F.row_number().over(newest)).filter("_age <= 30")
    )
    counted = last.withColumn("_rows", F.count("*").over(Window.partitionBy("ticker")))
    clean = counted.filter("close is not null").withColumn("k", F.row_number().over(newest))
    prev = F.lead("close").over(newest)
    clean = clean.withColumn("ret", F.when(prev != 0, (F.col("close") - prev) / prev))
    ranked = clean.withColumn(
        "rk", F.when(F.col("ret").isNotNull(), F.count("ret").over(newest.rowsBetween(Window.unboundedPreceding, 0))))
    recent = F.col("rk") <= 14
    agg = ranked.groupBy("ticker").agg(
        F.max("_rows").alias("rows"), F.count("*").alias("closes"), F.count("ret").alias("returns"),
        F.max(F.when(F.col("k") == 1, F.col("close"))).alias("now"),
        F.max(F.when(F.col("k") == 5, F.col("close"))).alias("then"),
        F.stddev_pop("ret").alias("dev"),
        F.sum(F.when(recent, F.greatest(F.col("ret"), F.lit(0.0)))).alias("gain"),
        F.sum(F.when(recent, F.greatest(-F.col("ret"), F.lit(0.0)))).alias("loss"),
    )
    enough = F.col("rows") >= 5
    rsi_col = F.when(F.col("loss") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("gain") / F.col("loss")))
    return agg.select(
        "ticker",
        F.when(enough & (F.col("returns") >= 5), F.col("dev") * (252 ** 0.5)).alias("volatility_21d"),
        F.when(enough & (F.col("returns") >= 14), rsi_col).alias("rsi_14"),
        F.when(enough & (F.col("closes") >= 5) & (F.col("then") != 0), (F.col("now") - F.col("then")) / F.col("then"))
        .alias("price_change_5d"),
    )


def latest_close(prices: DataFrame) -> DataFrame:
    """Last close per ticker."""
    return prices.groupBy("ticker").agg(
        F.max_by("close", "date").alias("current_price"), F.max("date").alias("price_date"))
