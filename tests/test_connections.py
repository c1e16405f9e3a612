"""Patterns on the edge table that join members, companies and firms."""

from datetime import date

from filinglens.operators import graph, resolve

EDGE = "src_type string, src string, rel string, dst_type string, dst string, trade_id long, transaction_type string, transaction_date date, total_amount double, contribution_count long"


def _edges(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (10 - len(r))) for r in rows], EDGE)


def test_connections_list_every_lobbying_link(spark):
    traded = [("Member", m, "TRADED", "Company", c, i, "purchase", date(2020, 1, 1)) for i, (m, c) in enumerate(
        [("m", "B"), ("m", "A"), ("m", "A"), ("n", "C")])]
    lobby = [("LobbyingFirm", f, "LOBBIED_FOR", "Company", c) for f, c in [("2", "A"), ("10", "A"), ("2", "A"), ("3", "B"), ("4", "Z")]]
    got = {r.member: r for r in graph.connections(_edges(spark, traded + lobby)).collect()}
    assert [tuple(c) for c in got["m"].lobbying_connections] == [("A", "A:10,A:2"), ("B", "B:3")]
    assert [tuple(c) for c in got["m"].traded_companies] == [("A", 2), ("B", 1)] and got["m"].lobbying_link_count == 3
    assert got["n"].lobbying_connections == [] and got["n"].lobbying_link_count == 0
    assert list(graph.connections(_edges(spark, traded + lobby), ["n"]).toPandas().member) == ["n"]


def test_newest_overlaps_without_the_product_of_bills_and_firms(spark):
    seats = [("Member", m, "SITS_ON", "Committee", c) for m, c in [("m", "x"), ("m", "y"), ("n", "y"), ("o", "z")]]
    bills = [("Bill", f"b{i:03d}", "REFERRED_TO", "Committee", c) for i in range(40) for c in ("x", "y") if (i % 3 > 0) == (c == "x")]
    firms = [("LobbyingFirm", f"f{i:03d}", "LOBBIED_FOR", "Company", c) for i in range(30) for c in ("A", "B")]
    trades = [("Member", m, "TRADED", "Company", c, i, "sale", date(2020, 1, 1 + i % 3)) for i, (m, c) in enumerate(
        [("m", "A"), ("n", "B"), ("n", "C"), ("o", "A"), ("m", "B"), ("m", "B")])]
    edges = _edges(spark, seats + bills + firms + trades)
    columns = ["transaction_date", "member", "ticker", "transaction_type", "committee", "bill", "firm"]
    whole = [tuple(r) for r in graph.committee_overlap(edges, None).select(*columns).collect()]
    first = sorted(whole, key=lambda r: (-r[0].toordinal(), *r[1:]))
    for n in (1500, 7):
        cut = graph.committee_overlap(edges, n)
        assert [tuple(r) for r in cut.select(*columns).collect()] == first[:n]
    assert "WindowGroupLimit" in cut._jdf.queryExecution().toString()


def test_committees_meet_members_by_distinct_name(spark):
    members = spark.createDataFrame(
        [("2", "Ann", "Lee"), ("1", "Ann", "lee"), ("3", "Bo", "Lee"), ("4", None, "Lee"), ("5", "Cy", "")],
        "bioguide_id string, first_name string, last_name string")
    committees = spark.createDataFrame(
        [("C1", "Friends of ANN LEE", None), ("C2", "Bo Leeson", None), ("C3", "Ann Lee", "9"), ("C4", "Dee", None), ("C5", None, None)],
        "fec_committee_id string, name string, member_bioguide_id string")
    df = resolve.link_committees(committees, members)
    assert {r[0]: r[1] for r in df.select("fec_committee_id", "member_bioguide_id").collect()} == {
        "C1": "1", "C2": "3", "C3": "9", "C4": None, "C5": None}
    assert "min(bioguide_id" in df._jdf.queryExecution().analyzed().toString().split("Generate explode")[-1]
