"""The training frame: base rows, labels and all feature groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions import features as X
from ..operators import asof, dayrange, history, indicators
from ..session import Scratch
from . import stats


def trainable_trades(
    trades: DataFrame, as_of: date, horizon: str = "180d", etfs: list[str] | None = None, since: str = K.TRAINING_START,
    keep_untyped: bool = False,
) -> DataFrame:
    """Single-stock trades old enough to have an outcome.

    A name that looks like an option drops the row, and so does a missing asset
    name or, unless ``keep_untyped``, a missing asset type.
    """
    cutoff = as_of - timedelta(days=K.HORIZON_BUFFER_DAYS[horizon])
    cond = (
        (F.col("ticker") != "") & (F.col("transaction_date") >= F.lit(since).cast("date"))
        & (F.col("transaction_date") <= F.lit(cutoff)) & ~F.col("ticker").isin(list(etfs or K.EXCLUDED_ETFS)))
    for pattern in K.OPTION_NAME_PATTERNS:
        cond = cond & ~F.col("asset_name").ilike(pattern)
    plain = ~F.col("asset_type").ilike(K.OPTION_TYPE_PATTERN)
    return trades.filter(cond & (F.coalesce(plain, F.lit(True)) if keep_untyped else plain))


def trade_member(trades: DataFrame, members: DataFrame) -> DataFrame:
    """Trades with the attributes of their member, where known."""
    m = members.select(
        F.col("bioguide_id").alias("member_bioguide_id"), "party", F.col("chamber").alias("member_chamber"),
        "nominate_dim1", "nominate_dim2", "first_elected")
    return trades.withColumnRenamed("chamber", "trade_chamber").join(m, "member_bioguide_id", "left")


def cap_oldest(trades: DataFrame, n: int) -> DataFrame:
    """The n oldest trades (the size cap of a training set)."""
    return trades.orderBy("transaction_date", "trade_id").limit(n)


def labelled(trades: DataFrame, prices: DataFrame, horizon: str = "180d") -> DataFrame:
    """Base and future price, returns and label; rows without label dropped."""
    points = asof.nth_price_after(trades, prices, K.HORIZON_ROWS[horizon])
    return points.withColumns(X.labels()).filter("profitable is not null")


def sector_codes(sectors: DataFrame) -> DataFrame:
    """(ticker, sector, sector_encoded): dense number of the sorted sector names.

    The numbering window runs over the few distinct sectors.
    """
    from pyspark.sql import Window

    names = sectors.select("sector").filter("sector <> ''").distinct()
    numbered = names.select("sector", F.row_number().over(Window.orderBy("sector")).cast("double").alias("sector_encoded"))
    return sectors.join(F.broadcast(numbered), "sector", "left").select(
        "ticker", "sector", F.coalesce("sector_encoded", F.lit(0.0)).alias("sector_encoded"))


def sector_match(trades: DataFrame, assignments: DataFrame, sectors: DataFrame) -> DataFrame:
    """(member, ticker) pairs whose committee and stock share a sector."""
    spark = trades.sparkSession
    table = spark.createDataFrame(
        [(p.lower(), s) for p, names in K.COMMITTEE_SECTORS.items() for s in names], "prefix string, sector string")
    covered = assignments.select(
        "member_bioguide_id", F.lower(F.substring("committee_code", 1, 4)).alias("prefix")).distinct().join(
        F.broadcast(table), "prefix").select("member_bioguide_id", "sector").distinct()
    pairs = trades.select("member_bioguide_id", "ticker").dropna().distinct().join(sectors.select("ticker", "sector"), "ticker")
    return pairs.join(covered, ["member_bioguide_id", "sector"], "left_semi").select(
        "member_bioguide_id", "ticker", F.lit(1.0).alias("committee_sector_match"))


def network_columns(
    base: DataFrame, trades: DataFrame, clients: DataFrame, filings: DataFrame, contributions: DataFrame,
    committees: DataFrame, triangles: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Lobbying, donation and degree counts of the trade's ticker and member.

    The lobbying counts have a row per ticker and are broadcast. The rows end up
    placed by (member, ticker), so that another lookup by both moves no row.
    ``triangles`` (trade_id) flags trades in a suspicious triangle; ``keep`` writes a lookup out.
    """
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out = (
        base.join(F.broadcast(keep(stats.lobby_counts(clients, filings))), "ticker", "left")
        .join(keep(stats.trade_degree(trades)), "member_bioguide_id", "left")
        .join(keep(stats.donor_counts(contributions, committees)), ["member_bioguide_id", "ticker"], "left"))
    flag = F.lit(0.0)
    if triangles is not None:
        out = out.join(triangles.select("trade_id").distinct().withColumn("_tri", F.lit(1.0)), "trade_id", "left")
        flag = num("_tri")
    return out.withColumns({
        "lobbying_connection_count": num("filing_count"), "campaign_donor_connection": num("contribution_count"),
        "network_degree": num("degree"), "has_lobbying_triangle": flag,
    }).drop("filing_count", "contribution_count", "degree", "_tri")


@dataclass
class DatasetOptions:
    """What the training frame is built for."""

    as_of: date
    horizon: str = "180d"
    since: str = K.TRAINING_START
    benchmark: str = K.BENCHMARK_TICKER
    limit: int | None = None
    keep_untyped: bool = False
    point_in_time: bool = False
    trainable_only: bool = True


#: Text of a trade that at most the choice of trades reads, and text that features are made of.
FILED_TEXT = ["member_name", "asset_name", "asset_type", "source", "filing_url"]
CODED_TEXT = ["filer_type", "trade_chamber", "party", "member_chamber"]


def chosen_trades(t, options: DatasetOptions) -> DataFrame:
    """The trades that a frame of these options starts from."""
    base = t.trades
    if options.trainable_only:
        base = trainable_trades(base, options.as_of, options.horizon, since=options.since, keep_untyped=options.keep_untyped)
    return base if options.limit is None else cap_oldest(base, options.limit)


@dataclass
class CommonGroups:
    """What a frame holds whatever its horizon, written out.

    ``base`` has the chosen trades with what their member alone decides, ``wide``
    adds what member and ticker decide, the others have a row per trade or ticker.
    """

    base: DataFrame
    wide: DataFrame
    legislative: DataFrame
    velocity: DataFrame
    popularity: DataFrame
    sectors: DataFrame


def _slim(rows: DataFrame) -> DataFrame:
    return rows.select("trade_id", "ticker", "transaction_date", "member_bioguide_id", "transaction_type")


def _every(t, options: DatasetOptions) -> DataFrame:
    return t.trades.filter(F.col("ticker").isNotNull() & (F.col("transaction_date") >= F.lit(options.since).cast("date")))


def common_groups(
    t, trades: DataFrame, options: DatasetOptions, scratch: Scratch, triangles: DataFrame | None = None, texts: bool = True,
) -> CommonGroups:
    """Groups of these trades that no horizon changes.

    Each group is written out by itself, so the disk holds the shuffle files of
    one of them at a time. Without ``texts`` a trade's text is left out where no
    later step reads it.
    """
    keep = scratch.keep
    trades = trades if texts else trades.drop(*FILED_TEXT)
    rows = trade_member(trades, t.members)
    rows = rows.withColumns({**X.trade_features(), **X.member_features(options.as_of)})
    rows = rows.join(stats.committee_counts(t.assignments), "member_bioguide_id", "left").withColumn(
        "committee_count", F.coalesce(F.col("committee_count").cast("double"), F.lit(0.0)))
    base = keep(rows if texts else rows.drop(*CODED_TEXT))
    slim = _slim(base)
    legislative = keep(dayrange.legislative_features(slim, t.assignments, t.hearings, t.bills).drop(
        "ticker", "transaction_date", "member_bioguide_id", "transaction_type"))
    velocity = keep(history.member_velocity(slim, t.trades))
    if options.point_in_time:
        popularity = keep(history.ticker_popularity_before(_every(t, options)))
    else:
        popularity = keep(history.ticker_popularity(_every(t, options)))
    sectors = sector_codes(t.sectors)
    pairs = keep(sector_match(slim, t.assignments, sectors))
    rows = network_columns(base, t.trades, t.clients, t.filings, t.contributions, t.campaign_committees, triangles, keep)
    wide = keep(rows.join(pairs, ["member_bioguide_id", "ticker"], "left").withColumn(
        "committee_sector_match", F.coalesce("committee_sector_match", F.lit(0.0))))
    return CommonGroups(base, wide, legislative, velocity, popularity, sectors)


def with_outcomes(t, common: CommonGroups, options: DatasetOptions, scratch: Scratch) -> DataFrame:
    """The frame of one horizon: the common groups of its trades, their labels and what depends on these."""
    keep, rows = scratch.keep, common.base
    horizon_rows = K.HORIZON_ROWS[options.horizon]
    if options.trainable_only:
        old = F.col("transaction_date") <= F.lit(options.as_of - timedelta(days=K.HORIZON_BUFFER_DAYS[options.horizon]))
    else:
        old = F.lit(True)

    def labels(df: DataFrame) -> DataFrame:
        if options.trainable_only:
            return labelled(df, t.prices, options.horizon)
        return asof.nth_price_after(df, t.prices, horizon_rows).withColumns(X.labels())

    past = keep(history.member_history(_every(t, options), t.prices, horizon_rows))
    cross = keep(history.cross_member(_slim(labels(_slim(rows.filter(old))))))
    rows = labels(history.sample_weights(common.wide.filter(old), rows.filter(old)))
    # the rows move once by ticker and day, and once by trade for all that a trade has one row of
    rows = keep(indicators.attach_indicators(rows, t.prices))
    rows = rows.join(common.legislative, "trade_id").withColumn("timing_suspicion_score", X.timing_score())
    rows = rows.join(past, "trade_id", "left").withColumns({
        "member_win_rate": F.coalesce("member_win_rate", F.lit(0.5)),
        "member_trade_count": F.coalesce("member_trade_count", F.lit(0.0)),
        "member_avg_return": F.coalesce("member_avg_return", F.lit(0.0))})
    rows = rows.join(cross, "trade_id", "left").withColumns(X.calendar_features())
    rows = rows.join(common.velocity, "trade_id", "left")
    if options.point_in_time:
        rows = rows.join(common.popularity, "trade_id", "left")
    else:
        rows = rows.join(F.broadcast(common.popularity), "ticker", "left")
    rows = rows.withColumns({
        "ticker_total_members": F.coalesce(F.col("ticker_total_members").cast("double"), F.lit(0.0)),
        "ticker_total_trades": F.coalesce(F.col("ticker_total_trades").cast("double"), F.lit(0.0)),
        "ticker_purchase_ratio": F.coalesce("ticker_purchase_ratio", F.lit(0.5)),
        "member_trades_30d": F.coalesce("member_trades_30d", F.lit(0.0)),
        "member_trades_90d": F.coalesce("member_trades_90d", F.lit(0.0)),
        "member_velocity_ratio": F.coalesce("member_velocity_ratio", F.lit(1.0)),
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("cross_member_7d", "cross_member_30d", "cross_member_same_dir_7d")}})
    rows = history.sentiment_windows(rows, history.daily_sentiment(t.media, t.sentiment))
    rows = indicators.market_regime(rows, t.prices.filter(F.col("ticker") == options.benchmark))
    rows = rows.join(F.broadcast(common.sectors.select("ticker", "sector_encoded")), "ticker", "left").withColumn(
        "sector_encoded", F.coalesce("sector_encoded", F.lit(0.0)))
    rows = rows.withColumn("stock_vs_market_21d", X.excess_return()).withColumns(X.interactions())
    # features stay in the order of their groups, whatever the order of the joins
    order = [
        *FRAME_START, *indicators.DEFAULTS, *[c for c in common.legislative.columns if c != "trade_id"], *FRAME_MIDDLE,
        *X.calendar_features(), *FRAME_END, *X.interactions()]
    return rows.select(*[c for c in rows.columns if c not in order], *order)


FRAME_START = [
    "sample_weight", "base_price", "base_date", "price_future", "future_date", "actual_return", "directional_return", "profitable",
    "amount_midpoint", "amount_log", "is_purchase", "tx_direction", "filer_type_encoded", "disclosure_lag_days", "party_encoded",
    "chamber_encoded", "years_in_office", "committee_count"]
FRAME_MIDDLE = [
    "timing_suspicion_score", "avg_sentiment_7d", "avg_sentiment_30d", "sentiment_momentum", "media_mention_count_7d",
    "media_mention_count_30d", "lobbying_connection_count", "campaign_donor_connection", "network_degree", "has_lobbying_triangle",
    "member_win_rate", "member_trade_count", "member_avg_return", "cross_member_7d", "cross_member_30d", "cross_member_same_dir_7d"]
FRAME_END = [
    "ticker_total_members", "ticker_total_trades", "ticker_purchase_ratio", "member_trades_30d",
    "member_trades_90d", "member_velocity_ratio", "spy_return_21d", "spy_return_63d", "spy_volatility_21d", "market_is_bull",
    "sector_encoded", "committee_sector_match", "stock_vs_market_21d"]


def build_dataset(
    t, options: DatasetOptions, triangles: DataFrame | None = None, scratch: Scratch | None = None, texts: bool = True,
) -> DataFrame:
    """One row per labelled trade with all feature groups.

    ``t`` offers the domain tables. Every group is derived from the trades on
    distinct (key, day) pairs, written out and joined on the keys, never paired.
    Tables by day or by ticker are broadcast; the wide rows move once per key, and
    no two moves share the disk. What is written out goes to ``scratch``, which a
    caller may clear when the result is stored. Without ``texts`` the text of a
    trade that no feature reads is left out.
    """
    scratch = scratch or Scratch(t.spark, "dataset")
    common = common_groups(t, chosen_trades(t, options), options, scratch, triangles, texts)
    rows = with_outcomes(t, common, options, scratch)
    scratch.drop(common.base, common.wide)
    return rows


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither metadata nor label."""
    skip = set(K.FEATURE_METADATA_COLUMNS)
    return [f.name for f in df.schema.fields if f.name not in skip and f.dataType.simpleString() == "double"]


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN, infinities and nulls of the columns become 0."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(bad(F.col(c)), 0.0).otherwise(F.col(c)) for c in columns})


def select_features(df: DataFrame, least: float = 1e-10) -> list[str]:
    """Feature columns whose population variance exceeds the least; one pass."""
    columns = feature_columns(df)
    row = clean(df, columns).agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > least]


def feature_vector(dataset: DataFrame, ids: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """(trade_id, feature_vector): the features as a map, for storage with a score."""
    columns = columns or feature_columns(dataset)
    rows = dataset if ids is None else dataset.filter(F.col("trade_id").isin(ids))
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns]))
    return rows.select("trade_id", pairs.alias("feature_vector"))
