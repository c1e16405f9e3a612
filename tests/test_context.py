"""Nested contexts: lists are shared by members of the same committees."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from filinglens.operators import dayrange

D = date(2020, 1, 10)
TRADE = "trade_id long, member_bioguide_id string, transaction_date date"


def _seats(spark):
    return spark.createDataFrame(
        [("m", "hsba00"), ("m", "ssaf00"), ("n", "ssaf00"), ("n", "hsba00"), ("n", "hsba00"), ("o", "hsba01"), (None, "hsba00")],
        "member_bioguide_id string, committee_code string")


def test_bills_of_a_shared_list_keep_each_members_own(spark):
    ref = lambda *codes: [(c,) for c in codes]
    bills = spark.createDataFrame(
        [("b1", "T", D - timedelta(days=90), "P", "m", ref("hsba05", "ssaf00")), ("b2", "T", D + timedelta(days=91), "P", "m", ref("hsba00")),
         ("b3", "T", D, "P", "n", ref("ssaf00")), ("b3", "T", D, "P", None, ref("ssaf00")), ("b3", "T", D, "P", "x", ref("hsba00")),
         ("b4", "T", None, "P", "m", ref("hsba00")), ("b5", "T", D + timedelta(days=2), None, None, ref(None, "xxxx00"))],
        "bill_id string, title string, introduced_date date, policy_area string, sponsor_bioguide_id string, committees array<struct<code string>>")
    trades = spark.createDataFrame([(1, "m", D), (2, "n", D), (2, "n", D), (3, None, D), (4, "m", None), (5, "z", D), (6, "o", D)], TRADE)
    got = dayrange.context_bills(trades, _seats(spark), bills, 90).select(
        "trade_id", F.transform("nearby_bills", lambda b: F.struct(b["bill_id"], b["distance_days"], b["is_sponsor"])).alias("l"),
        "n_bills", "sum_distance_days", "min_bill_distance_days", "first_bill_id", "has_sponsored_bill").collect()
    got = sorted((r[0], [tuple(x) for x in r.l] if r.l is not None else None, *r[2:]) for r in got)
    own = (2, [("b1", -90, False), ("b3", 0, False), ("b3", 0, True)], 3, -90, 0, "b1", True)
    assert got[:3] == [(1, [("b1", -90, True), ("b3", 0, False)], 2, -90, 0, "b1", True), own, own]
    assert got[3:6] == [(i, None, None, None, None, None, None) for i in (3, 4, 5)]
    assert got[6] == (6, [("b1", -90, False), ("b3", 0, False)], 2, -90, 0, "b1", False)


def test_hearings_are_gathered_once_per_committee_set(spark):
    hearings = spark.createDataFrame(
        [(i, f"H{i}", "hsba00", D + timedelta(days=o)) for i, o in enumerate([-31, -30, -1, 0, 30, 31])] + [(9, "H", "ssaf00", D), (9, "H", "ssaf00", D)],
        "hearing_id long, title string, committee_code string, hearing_date date")
    trades = spark.createDataFrame([(1, "m", D), (2, "n", D), (3, "o", D), (4, None, D)], TRADE)
    df = dayrange.context_hearings(trades, _seats(spark), hearings, 30)
    got = {r.trade_id: r for r in df.collect()}
    listed = lambda r: [(h.hearing_id, h.distance_days, h.before_trade) for h in r.nearby_hearings]
    assert listed(got[1]) == listed(got[2]) == [(1, -30, True), (2, -1, True), (3, 0, False), (9, 0, False), (9, 0, False), (4, 30, False)]
    assert got[1].min_hearing_distance_days == 0 and got[3].nearby_hearings is None and got[4].nearby_hearings is None
    # both members ask for one list: it is keyed by their committees, not by the member
    sets, codes = dayrange.committee_sets(_seats(spark), F.col("committee_code"))
    assert sets.filter("member_bioguide_id in ('m', 'n')").select("_set").distinct().count() == 1 and codes.count() == 3


def test_bill_figures_need_no_lists(spark):
    codes = ["hsba", "ssaf", "hsag"]
    bills = spark.createDataFrame(
        [(f"b{i * 7 % 40:02d}", f"T{i % 3}", D + timedelta(days=i * 37 % 400 - 200), None, ["m", "n", None][i % 3], [(codes[i % 3] + "00",), (codes[i % 2] + "05",)])
         for i in range(150)],
        "bill_id string, title string, introduced_date date, policy_area string, sponsor_bioguide_id string, committees array<struct<code string>>")
    trades = spark.createDataFrame([(i, ["m", "n", "o"][i % 3], D + timedelta(days=i * 13 % 300 - 150)) for i in range(60)], TRADE)
    df = dayrange.context_bills(trades, _seats(spark), bills, 90)
    figures = ["n_bills", "sum_distance_days", "min_bill_distance_days", "first_bill_id", "has_sponsored_bill"]
    for r in df.collect():
        listed = r.nearby_bills
        away = [b.distance_days for b in listed or []]
        assert [r[c] for c in figures] == ([len(away), sum(away), min(map(abs, away)), min(b.bill_id for b in listed), any(
            b.is_sponsor for b in listed)] if listed else [None] * 5)
    assert df.filter("n_bills is not null").count() > 40
    plan = lambda *c: df.select("trade_id", *c)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan("nearby_bills") and "collect_list" not in plan(*figures)
