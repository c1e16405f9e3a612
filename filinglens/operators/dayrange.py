"""Range joins and date-range windows on calendar days.

Counts and nearest distances never pair rows: events are pre-aggregated per day
(map-side combined), a RANGE frame turns them into window totals on the days
that are asked for, and an equi-join brings them back. Only operators whose
result *is* the list of partners join rows, on (key, day bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import join_days, key_days


def day_totals(
    grid: DataFrame, daily: DataFrame, keys: Sequence[str], totals: dict[str, tuple[str, int, int]],
    nearest: bool = False,
) -> DataFrame:
    """Window totals around each grid day.

    ``grid`` holds distinct (keys, _day); ``daily`` holds one row per (keys,
    _day) with numeric columns. ``totals`` maps an output to (column, lo, hi):
    the sum over days _day+lo .. _day+hi. ``nearest`` adds the distance in days
    to the closest event day on either side. Both inputs have at most one row
    per key and day, so the window partitions are bounded by the calendar.
    """
    sources = sorted({column for column, _, _ in totals.values()})
    events = daily.select(
        *keys, "_day", *[F.col(c).cast("double").alias(c) for c in sources], F.col("_day").alias("_event"))
    asked = grid.select(*keys, "_day", *[F.lit(None).cast("double").alias(c) for c in sources])
    asked = asked.withColumn("_event", F.lit(None).cast("date"))
    both = events.withColumn("_ask", F.lit(False)).unionByName(asked.withColumn("_ask", F.lit(True)))
    both = both.withColumn("_n", F.unix_date("_day"))
    order = Window.partitionBy(*keys).orderBy("_n")
    for name, (column, lo, hi) in totals.items():
        both = both.withColumn(f"_t_{name}", F.sum(column).over(order.rangeBetween(lo, hi)))
    out = [F.coalesce(F.col(f"_t_{name}"), F.lit(0.0)).alias(name) for name in totals]
    if nearest:
        before = F.max("_event").over(order.rangeBetween(Window.unboundedPreceding, 0))
        after = F.min("_event").over(order.rangeBetween(0, Window.unboundedFollowing))
        both = both.withColumn("_before", before).withColumn("_after", after)
        out.append(
            F.least(F.datediff("_day", "_before"), F.datediff("_after", "_day")).alias("nearest"))
    return both.filter("_ask").select(*keys, "_day", *out)


def hearing_proximity(
    trades: DataFrame, assignments: DataFrame, hearings: DataFrame, same_congress: bool = False,
) -> DataFrame:
    """Hearings of the member's committees within 30 days of each trade.

    One row per trade that has any. Assignments of every congress count unless
    ``same_congress`` asks for the one in session on the trade date. Members of the
    same committees share their figures: these are made once per set of seats and day.
    """
    from ..functions.text import session_number

    named = ["committee_code", "congress_number"] if same_congress else ["committee_code"]
    seats = assignments.select("member_bioguide_id", "committee_code", "congress_number").dropna().select(
        "member_bioguide_id", F.struct(*named).alias("seat"))
    sets = seats.groupBy("member_bioguide_id").agg(F.array_sort(F.collect_set("seat")).alias("_set"))
    held = trades.select("trade_id", "member_bioguide_id", "transaction_date").join(sets, "member_bioguide_id").select(
        "trade_id", "_set", F.col("transaction_date").alias("_on"))
    asked = held.select("_set", F.col("_on").alias("_day")).dropna().distinct().select("_set", "_day", F.explode("_set").alias("seat")).select(
        "_set", "_day", "seat.*")
    if same_congress:
        asked = asked.filter(session_number("_day") == F.col("congress_number")).drop("congress_number").distinct()
    daily = (
        hearings.select("committee_code", F.col("hearing_date").alias("_day"), "hearing_id").dropna().distinct()
        .groupBy("committee_code", "_day").agg(F.count("*").alias("n"))
    )
    around = day_totals(
        asked.select("committee_code", "_day").distinct(), daily, ["committee_code"],
        {"hearing_count": ("n", -30, 30), "before_7d": ("n", -7, -1), "after_7d": ("n", 1, 7),
         "before_3d": ("n", -3, -1)},
        nearest=True,
    )
    per_day = (
        asked.join(around, ["committee_code", "_day"])
        .groupBy("_set", "_day")
        .agg(
            *[F.sum(c).cast("long").alias(c) for c in ("hearing_count", "before_7d", "after_7d", "before_3d")],
            F.min("nearest").alias("min_hearing_dist"),
        )
        .filter("hearing_count > 0")
    )
    return join_days(held, per_day, ["_set"], "_on", "inner").drop("_set", "_on")


def bill_day() -> Column:
    return F.coalesce("introduced_date", "latest_action_date")


def sponsored_bills(trades: DataFrame, bills: DataFrame) -> DataFrame:
    """The member's own bills within 90 days: count and nearest distance."""
    daily = (
        bills.select(
            F.col("sponsor_bioguide_id").alias("member_bioguide_id"), bill_day().alias("_day"), "bill_id"
        ).dropna().distinct().groupBy("member_bioguide_id", "_day").agg(F.count("*").alias("n"))
    )
    around = day_totals(
        key_days(trades, ["member_bioguide_id"], "transaction_date"), daily, ["member_bioguide_id"],
        {"sponsored_count": ("n", -90, 90)}, nearest=True,
    ).filter("sponsored_count > 0")
    return join_days(
        trades.select("trade_id", "member_bioguide_id", "transaction_date"), around, ["member_bioguide_id"],
        "transaction_date", "inner",
    ).select("trade_id", F.col("sponsored_count").cast("long"), F.col("nearest").alias("min_sponsored_dist"))


def nearby_bills(trades: DataFrame, bills: DataFrame) -> DataFrame:
    """Any bills within 90 days of the trade (trades without member included).

    A pure range join, answered from daily bill counts: the one window has a
    row per calendar day, never a trade-by-bill pair.
    """
    daily = bills.select(bill_day().alias("_day")).dropna().groupBy("_day").agg(F.count("*").alias("n"))
    everywhere = F.lit(0).alias("_all")
    around = day_totals(
        key_days(trades, [], "transaction_date").select(everywhere, "_day"), daily.select(everywhere, "_day", "n"),
        ["_all"], {"bill_count": ("n", -90, 90)}, nearest=True,
    ).filter("bill_count > 0").drop("_all")
    return join_days(
        trades.select("trade_id", "transaction_date"), around, [], "transaction_date", "inner",
    ).select("trade_id", F.col("bill_count").cast("long"), F.col("nearest").alias("min_bill_dist"))


def legislative_features(
    trades: DataFrame, assignments: DataFrame, hearings: DataFrame, bills: DataFrame,
) -> DataFrame:
    """Merge of the three proximities; 999 stands for none, own bills go first."""
    num = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default))
    joined = (
        trades.join(hearing_proximity(trades, assignments, hearings), "trade_id", "left")
        .join(sponsored_bills(trades, bills), "trade_id", "left")
        .join(nearby_bills(trades, bills), "trade_id", "left")
    )
    return joined.withColumns({
        "min_hearing_distance": num("min_hearing_dist", 999.0),
        "min_bill_distance": F.coalesce(
            F.col("min_sponsored_dist").cast("double"), F.col("min_bill_dist").cast("double"), F.lit(999.0)),
        "has_related_bill": (
            F.col("sponsored_count").isNotNull() | F.col("bill_count").isNotNull()).cast("double"),
        "nearby_hearing_count": num("hearing_count", 0.0),
        "nearby_bill_count": num("bill_count", 0.0),
        "sponsored_bill_near_trade": num("sponsored_count", 0.0),
        "hearings_before_7d": num("before_7d", 0.0),
        "hearings_after_7d": num("after_7d", 0.0),
        "hearings_before_3d": num("before_3d", 0.0),
    }).drop(
        "hearing_count", "before_7d", "after_7d", "before_3d", "min_hearing_dist", "sponsored_count",
        "min_sponsored_dist", "bill_count", "min_bill_dist",
    )


def within_days(
    asked: DataFrame, events: DataFrame, keys: Sequence[str], event_day: str, days: int,
) -> DataFrame:
    """Pairs of asked (keys, _day) rows and events at most ``days`` apart.

    Equi-join on keys plus a day bucket as wide as the window, then the exact
    range filter; adds the signed distance_days (negative = before).
    """
    width = max(days, 1)
    bucket = lambda c: F.floor(c / width)
    n = F.unix_date("_day")
    left = asked.withColumn("_b", F.explode(F.sequence(bucket(n - days), bucket(n + days))))
    right = events.withColumn("_b", bucket(F.unix_date(event_day)))
    return (
        left.join(right, [*keys, "_b"])
        .withColumn("distance_days", F.datediff(event_day, "_day"))
        .filter(F.abs("distance_days") <= days)
        .drop("_b")
    )


def lists_within(asked: DataFrame, events: DataFrame, keys: Sequence[str], event_day: str, days: int) -> DataFrame:
    """Per asked (keys, _day), the events at most ``days`` apart as a sorted list ``_near``.

    Events are gathered once per key and bucket, a bucket as wide as the window
    together with its two neighbours, and every asked day cuts its own window out
    of that list. So the events are shuffled three times each, never once per
    day that sees them. Days without events give null.
    """
    width = max(days, 1)
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    b = bucket(event_day)
    item = F.struct(*[c for c in events.columns if c not in keys])
    gathered = (
        events.filter(F.col(event_day).isNotNull())
        .select("*", F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
        .groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(item)).alias("_all")))
    return asked.withColumn("_b", bucket("_day")).join(gathered, [*keys, "_b"]).select(
        *keys, "_day",
        F.filter("_all", lambda e: F.abs(F.datediff(e[event_day], F.col("_day"))) <= days).alias("_near"),
    ).withColumn("_near", F.when(F.size("_near") > 0, F.col("_near")))


def committee_sets(assignments: DataFrame, code: Column) -> tuple[DataFrame, DataFrame]:
    """(member_bioguide_id, _set) and (_set, code): what is near a day depends on the set and the day alone."""
    seats = assignments.select("member_bioguide_id", code.alias("code")).dropna().distinct()
    sets = seats.groupBy("member_bioguide_id").agg(F.array_sort(F.collect_set("code")).alias("_set"))
    return sets, sets.select("_set").distinct().select("_set", F.explode("_set").alias("code"))


def _set_days(trades: DataFrame, sets: DataFrame, stem: str) -> DataFrame:
    """Per trade the member, the member's committee set and the day, under names of their own."""
    return trades.select("trade_id", "member_bioguide_id", "transaction_date").join(sets, "member_bioguide_id", "left").select(
        "trade_id", F.col("member_bioguide_id").alias(f"{stem}_member"), F.col("_set").alias(f"{stem}_set"),
        F.col("transaction_date").alias(f"{stem}_day"))


def _join_lists(rows: DataFrame, looked: DataFrame, stem: str, keys: Sequence[str]) -> DataFrame:
    right = looked.select(
        *[F.col(k).alias(f"_k{k}") for k in keys], *[c for c in looked.columns if c not in keys])
    names = {"member_bioguide_id": f"{stem}_member", "_set": f"{stem}_set", "_day": f"{stem}_day"}
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(names[k]) == F.col(f"_k{k}"))
    return rows.join(right, on, "left").drop(*[f"_k{k}" for k in keys])


def _asked(days: DataFrame, stem: str) -> DataFrame:
    return days.select(F.col(f"{stem}_set").alias("_set"), F.col(f"{stem}_day").alias("_day")).dropna().distinct()


def _hearing_context(trades: DataFrame, assignments: DataFrame, hearings: DataFrame, days: int):
    """(per trade its committee set and day, a function that adds the hearings to such rows)."""
    sets, codes = committee_sets(assignments, F.col("committee_code"))
    keyed = _set_days(trades, sets, "_h")
    held = hearings.join(codes, F.col("committee_code") == F.col("code")).select(
        "_set", F.col("hearing_date").alias("date"), "hearing_id", "title", "committee_code")
    near = lists_within(_asked(keyed, "_h"), held, ["_set"], "date", days)
    away = lambda e: F.datediff(e["date"], F.col("_day"))
    lists = near.select(
        "_set", "_day",
        F.transform("_near", lambda e: F.struct(
            e["date"].alias("date"), e["hearing_id"].alias("hearing_id"), e["title"].alias("title"),
            e["committee_code"].alias("committee_code"), away(e).alias("distance_days"),
            (away(e) < 0).alias("before_trade"))).alias("nearby_hearings"),
        F.array_min(F.transform("_near", lambda e: F.abs(away(e)))).alias("min_hearing_distance_days"))

    def add(rows: DataFrame) -> DataFrame:
        return _join_lists(rows, lists, "_h", ["_set", "_day"]).drop("_h_member", "_h_set", "_h_day")

    return keyed, add


def context_hearings(trades: DataFrame, assignments: DataFrame, hearings: DataFrame, days: int = 30) -> DataFrame:
    """Per trade, the hearings of the member's committees around it, nested.

    Members of the same committees see the same hearings on a day: the list is
    built once per committee set and day and joined to the trades last.
    """
    keyed, add = _hearing_context(trades, assignments, hearings, days)
    return add(keyed)


def _bill_figures(asked: DataFrame, referred: DataFrame, days: int) -> DataFrame:
    """Per asked (_set, _day) with bills near it: their number _n, _sum of distances, nearest and first id.

    Bills are counted per set and date and totalled by RANGE frames over the
    dates: a set's window has a row per day, however many bills a day brings.
    """
    n = F.unix_date("date")
    daily = referred.groupBy("_set", F.col("date").alias("_day")).agg(
        F.count("*").alias("bills"), F.sum(n.cast("long")).alias("dates"), F.min("bill_id").alias("first"))
    both = daily.withColumn("_ask", F.lit(False)).unionByName(
        asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True).withColumn("_at", F.unix_date("_day"))
    order = Window.partitionBy("_set").orderBy("_at")
    around, before, after = order.rangeBetween(-days, days), order.rangeBetween(-days, 0), order.rangeBetween(0, days)
    event = F.when(F.col("bills") > 0, F.col("_at"))
    out = both.select(
        "_set", "_day", "_ask", "_at", F.sum("bills").over(around).alias("_n"), F.sum("dates").over(around).alias("_dates"),
        F.min("first").over(around).alias("first_bill_id"), F.max(event).over(before).alias("_before"), F.min(event).over(after).alias("_after"))
    return out.filter(F.col("_ask") & (F.col("_n") > 0)).select(
        "_set", "_day", "_n", F.least(F.col("_at") - F.col("_before"), F.col("_after") - F.col("_at")).alias("min_bill_distance_days"),
        (F.col("_dates") - F.col("_n") * F.col("_at")).alias("_sum"), "first_bill_id")


def _bill_context(trades: DataFrame, assignments: DataFrame, bills: DataFrame, days: int):
    """(per trade its committee set and day, a function that adds the bills to such rows)."""
    prefix = lambda c: F.substring(c, 1, 4)
    sets, codes = committee_sets(assignments, prefix("committee_code"))
    keyed = _set_days(trades, sets, "_b")
    referred = (
        bills.filter(F.col("introduced_date").isNotNull())
        .select(
            "bill_id", F.substring("title", 1, 200).alias("title"), F.col("introduced_date").alias("date"), "policy_area",
            "sponsor_bioguide_id",
            F.explode(F.array_distinct(F.transform("committees", lambda c: prefix(c["code"])))).alias("code"))
        .join(codes, "code")
        .groupBy("_set", "date", "bill_id", "title", "policy_area").agg(
            F.collect_set("sponsor_bioguide_id").alias("sponsors"),
            F.max(F.col("sponsor_bioguide_id").isNull()).alias("unsponsored"))
    )
    asked = _asked(keyed, "_b")
    away = lambda e, day="_day": F.datediff(e["date"], F.col(day))
    lists = lists_within(asked, referred, ["_set"], "date", days)
    figures = _bill_figures(asked, referred, days)
    # the member's own bills among them; one that others stand behind too is listed a second time, as the member's
    own = referred.select(
        "_set", "date", F.explode("sponsors").alias("member_bioguide_id"),
        (F.col("unsponsored") | (F.size("sponsors") > 1)).alias("_twice"))
    days_of = keyed.select(
        F.col("_b_member").alias("member_bioguide_id"), F.col("_b_set").alias("_set"), F.col("_b_day").alias("_day"),
    ).dropna().distinct()
    sponsored = within_days(days_of, own, ["member_bioguide_id", "_set"], "date", days).groupBy(
        "member_bioguide_id", "_set", "_day").agg(
        F.count(F.when(F.col("_twice"), 1)).alias("_more"),
        F.sum(F.when(F.col("_twice"), F.col("distance_days"))).alias("_more_sum"), F.lit(True).alias("_own"))

    def item(e: Column, own: bool) -> Column:
        return F.struct(
            e["date"].alias("date"), e["bill_id"].alias("bill_id"), e["title"].alias("title"),
            e["policy_area"].alias("policy_area"), away(e, "_b_day").alias("distance_days"), F.lit(own).alias("is_sponsor"))

    def seen(e: Column) -> Column:
        mine = F.array_contains(e["sponsors"], F.col("_b_member"))
        others = e["unsponsored"] | (F.size(e["sponsors"]) > mine.cast("int"))
        return F.when(mine & others, F.array(item(e, False), item(e, True))).when(mine, F.array(item(e, True))).otherwise(
            F.array(item(e, False)))

    def add(rows: DataFrame) -> DataFrame:
        both = _join_lists(rows, sponsored, "_b", ["member_bioguide_id", "_set", "_day"])
        both = _join_lists(both, figures, "_b", ["_set", "_day"])
        both = _join_lists(both, lists, "_b", ["_set", "_day"])
        some = F.col("_n").isNotNull()
        return both.withColumns({
            "nearby_bills": F.flatten(F.transform("_near", seen)),
            "n_bills": F.col("_n") + F.coalesce("_more", F.lit(0)),
            "sum_distance_days": F.col("_sum") + F.coalesce("_more_sum", F.lit(0)),
            "has_sponsored_bill": F.when(some, F.coalesce("_own", F.lit(False))),
        }).drop("_b_member", "_b_set", "_b_day", "_near", "_n", "_sum", "_more", "_more_sum", "_own")

    return keyed, add


def context_bills(trades: DataFrame, assignments: DataFrame, bills: DataFrame, days: int = 90) -> DataFrame:
    """Per trade, the bills before the member's committees around it, nested, with their figures.

    Committees agree on their four-letter prefix; a bill is listed once. As with
    the hearings, a list and its figures (n_bills, sum_distance_days,
    min_bill_distance_days, first_bill_id) are made once per committee set and
    day, the figures without the list; what depends on the member, its own bills,
    is counted on the member's days.
    """
    keyed, add = _bill_context(trades, assignments, bills, days)
    return add(keyed)


def context_votes(trades: DataFrame, votes: DataFrame, days: int = 7) -> DataFrame:
    """Per trade, the member's votes around it, nested."""
    grid = key_days(trades, ["member_bioguide_id"], "transaction_date")
    pairs = within_days(grid, votes, ["member_bioguide_id"], "vote_date", days)
    item = F.struct(F.col("vote_date").alias("date"), "position", "question", "result")
    per_day = pairs.groupBy("member_bioguide_id", "_day").agg(
        F.array_sort(F.collect_list(item)).alias("nearby_votes"))
    return _back(trades, per_day)


def _back(trades: DataFrame, per_day: DataFrame) -> DataFrame:
    return join_days(
        trades.select("trade_id", "member_bioguide_id", "transaction_date"), per_day, ["member_bioguide_id"],
        "transaction_date",
    ).drop("member_bioguide_id", "transaction_date")


def sector_alignment(trades: DataFrame, assignments: DataFrame, keywords: DataFrame) -> DataFrame:
    """Committees of the member whose keywords occur in the asset name.

    ``keywords`` is a small (prefix, keyword) table. Keywords are matched once
    per distinct asset name; members meet the hit prefixes by an equi-join.
    """
    names = trades.filter("ticker is not null").select("asset_name").dropna().distinct()
    hits = names.join(
        F.broadcast(keywords), F.expr("contains(lower(asset_name), keyword)")
    ).select("asset_name", "prefix").distinct()
    seats = assignments.select(
        "member_bioguide_id", "committee_code", F.upper(F.substring("committee_code", 1, 4)).alias("prefix")
    ).dropna().distinct()
    wanted = trades.filter("ticker is not null").select("member_bioguide_id", "asset_name").dropna().distinct()
    aligned = (
        wanted.join(hits, "asset_name").join(seats, ["member_bioguide_id", "prefix"])
        .groupBy("member_bioguide_id", "asset_name")
        .agg(F.array_sort(F.collect_set("committee_code")).alias("aligned_committees"))
    )
    left = trades.select("trade_id", "member_bioguide_id", "asset_name", "ticker")
    joined = left.join(aligned, ["member_bioguide_id", "asset_name"], "left")
    codes = F.when(F.col("ticker").isNotNull(), F.col("aligned_committees"))
    codes = F.coalesce(codes, F.array().cast("array<string>"))
    return joined.select(
        "trade_id", codes.alias("aligned_committees"), (F.size(codes) > 0).alias("committee_sector_alignment"))


def legislative_context(
    trades: DataFrame, assignments: DataFrame, hearings: DataFrame, bills: DataFrame, votes: DataFrame,
    keywords: DataFrame, hearing_days: int = 30, bill_days: int = 90,
) -> DataFrame:
    """The full nested context of every trade with its heuristic score.

    Without a member or without committees the context is empty and scores 0.
    """
    from ..functions.features import suspicion_score

    seated = assignments.select("member_bioguide_id").distinct().withColumn("_seated", F.lit(True))
    base = trades.select(
        "trade_id", "member_bioguide_id", F.datediff("disclosure_date", "transaction_date").alias("disclosure_lag_days"))
    hearing_days_of, add_hearings = _hearing_context(trades, assignments, hearings, hearing_days)
    bill_days_of, add_bills = _bill_context(trades, assignments, bills, bill_days)
    # the lists come last, so that no join moves them
    ctx = (
        base.join(seated, "member_bioguide_id", "left")
        .join(hearing_days_of, "trade_id", "left")
        .join(bill_days_of, "trade_id", "left")
        .join(context_votes(trades, votes), "trade_id", "left")
        .join(sector_alignment(trades, assignments, keywords), "trade_id", "left")
        .withColumn("nearby_votes", F.when(F.col("_seated"), F.col("nearby_votes")))
    )
    ctx = add_hearings(add_bills(ctx))
    return ctx.withColumn(
        "timing_suspicion_score", F.when(F.col("_seated"), suspicion_score()).otherwise(0.0)).drop("_seated")
