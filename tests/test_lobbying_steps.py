"""Lobbying filings: a position is lowered once per lobbyist, odd records keep their results."""

from filinglens.sources import network

REC = network.LOBBYING_SCHEMA


def _person(first, last, position, prefix=None):
    return ((first, last, prefix), position)


def _filing(uuid, acts):
    return (uuid, "Q1", None, None, "2024-01-02", None, None, "5", ("1", "R", None), ("C", None, None, None), acts)


def test_position_is_lowered_once(spark):
    df = network.normalise_lobbying(spark.createDataFrame([_filing("u", [])], REC), 2024).select("lobbyists")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_odd_records(spark):
    acts = [
        ("TAX", "", [("B",), (None,), ("",), None, ("A",)], [_person("Ann", "Lee", "SENATOR"), None, _person("Ann", "Lee", "Secretary")]),
        (None, "S. 5 and H.R. 12", None, None), None,
        ("", None, [("A",)], [_person(None, "Bob", "", "Mr."), _person(" ", " ", "White House"), _person("", None, None)]),
        ("BUD", "x", [], [])]
    rows = {r.filing_uuid: r for r in network.normalise_lobbying(
        spark.createDataFrame([_filing("u", acts), _filing("v", None), _filing("", acts)], REC), 2024).collect()}
    assert set(rows) == {"u", "v"}
    u, v = rows["u"], rows["v"]
    assert [tuple(p) for p in u.lobbyists] == [
        ("Ann Lee", "SENATOR", True, False), ("Unknown", None, False, False), ("Mr.  Bob", None, False, False), ("", "White House", True, True)]
    assert u.specific_issues == ["S. 5 and H.R. 12", "x"] and u.lobbied_bills == ["S. 5", "H.R. 12"]
    assert u.general_issue_codes == ["BUD", "TAX"] and u.government_entities == ["A", "B"]
    assert v.lobbyists == v.specific_issues == v.general_issue_codes == v.government_entities == v.lobbied_bills == []
