"""Readers on small landed files."""

import json
from datetime import date

from filinglens.sources import legislation, media, network, trades


def test_house_json(spark, tmp_path):
    rec = {"transaction_date": "01/15/2024", "disclosure_date": "2024-02-01", "owner": "joint", "ticker": "--", "asset_description": " Apple ",
           "type": "sale_partial", "amount": "$1,001 - $15,000", "representative": "Hon. X", "ptr_link": "u", "cap_gains_over_200_usd": "False"}
    path = tmp_path / "h.json"
    path.write_text(json.dumps([rec, {**rec, "transaction_date": "soon"}]))
    got = trades.read_house_json(spark, str(path)).collect()
    assert len(got) == 1 and got[0]["filer_type"] == "member" and got[0]["ticker"] is None
    assert got[0]["transaction_type"] == "sale_partial" and got[0]["transaction_date"] == date(2024, 1, 15) and got[0]["asset_name"] == "Apple"


def test_senate_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("filer,ticker,transaction-date,amount,type,asset-name,owner\n\"Doe, Jane\",AAPL,1/5/24,\"$15,001 - $50,000\",Purchase,Apple,Joint\n,MSFT,1/5/24,,Sale,M,Self\n")
    got = trades.read_senate_csv(spark, str(path)).collect()
    assert len(got) == 1 and got[0]["filer_type"] == "joint" and got[0]["transaction_date"] == date(2024, 1, 5) and got[0]["amount_range_high"] == 50000


def test_membership_xml(spark, tmp_path):
    path = tmp_path / "c.xml"
    path.write_text("""<committees><committee code="HSAG" displayname="Agriculture" type="house"><member id="7" role="Chair"/><member id="x"/>
        <subcommittee code="3" displayname=""><member id="7" role="Vice Chair"/></subcommittee></committee></committees>""")
    cross = spark.createDataFrame([(7, "B1")], "govtrack long, bioguide string")
    got = sorted(tuple(r) for r in legislation.read_memberships_xml(spark, str(path), cross, 118).collect())
    assert got == [("B1", "hsag00", "Agriculture", "chair", 118), ("B1", "hsag30", "Agriculture - Subcommittee", "member", 118)]


def test_rss_and_posts(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><guid>g</guid><title>T</title><description>&lt;p&gt;Hi&amp;nbsp;you&lt;/p&gt;</description>"
                                    "<pubDate>Tue, 06 Feb 2024 09:00:00 GMT</pubDate></item></channel></rss>")
    got = media.read_rss(spark, str(tmp_path / "f.xml")).first()
    assert got["content"] == "Hi you" and got["published_date"] == date(2024, 2, 6)
    (tmp_path / "p.json").write_text(json.dumps([{"id": "1", "text": "x" * 101, "created_at": "2024-01-01T00:00:00Z"}]))
    assert media.read_posts(spark, str(tmp_path / "p.json")).first()["title"] == "x" * 100 + "..."


def test_lobbying(spark, tmp_path):
    rec = {"filing_uuid": "u", "filing_type": "Q1", "income": "$1,000.00", "dt_posted": "2024-01-02T00:00:00", "registrant": {"id": 5, "name": "R"},
           "client": {"name": "C"}, "lobbying_activities": [{"general_issue_code": "TAX", "description": "H.R. 12", "government_entities": None,
           "lobbyists": [{"lobbyist": {"first_name": "A", "last_name": "B"}, "covered_official_position": "Senator aide"}]}]}
    (tmp_path / "l.json").write_text(json.dumps([rec]))
    got = network.read_lobbying(spark, str(tmp_path / "l.json"), 2024).first()
    assert got["amount"] == 1000.0 and got["lobbied_bills"] == ["H.R. 12"] and got["lobbyists"][0]["is_former_congress"] and got["filing_date"] == date(2024, 1, 2)
