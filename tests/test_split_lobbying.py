"""Lobbying filings are written out once, and only those whose id repeats are moved by their id."""

from pyspark.sql import functions as F

from filinglens.operators import merge
from filinglens.session import Scratch


def test_rows_of_their_own_key_are_not_moved(spark):
    rows = [(i, f"u{i}", i % 5, None) for i in range(40)] + [(50, "u3", 0, "b"), (51, "u3", 0, "a"), (52, "u4", 9, None), (53, None, 1, "x"), (54, None, 0, "y")]
    df = spark.createDataFrame(rows, "n long, k string, o int, v string")
    few = merge.first_of_repeated(df, ["k"], ["o"], Scratch(spark, "test").keep)
    every = merge.first_per_key(df, ["k"], ["o"])
    assert sorted(map(str, few.collect())) == sorted(map(str, every.collect())) and few.count() == 41
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    lazily = merge.first_of_repeated(df, ["k"], ["o"], lambda x: x)
    assert sorted(map(str, lazily.collect())) == sorted(map(str, every.collect()))


def test_parts_read_the_filings_once(spark):
    rows = [(f"u{i % 7}", f"2001-01-0{1 + i % 3}", float(i), str(i % 2), f"c{i % 3}", ["Ann", f"Bo {i}"]) for i in range(9)]
    filings = spark.createDataFrame(rows, "filing_uuid string, filing_date string, amount double, sid string, client string, names array<string>").select(
        "filing_uuid", "filing_date", "amount", F.lit("Q1").alias("filing_type"), F.lit(2001).alias("filing_year"), F.lit("p").alias("filing_period"),
        F.struct(F.col("sid").alias("senate_id"), F.concat(F.lit("R"), "sid").alias("name"), F.lit("d").alias("description")).alias("registrant"),
        F.struct(F.col("client").alias("name"), *[F.lit("x").alias(c) for c in ("description", "country", "state")]).alias("client"),
        F.transform("names", lambda n: F.struct(n.alias("name"))).alias("lobbyists"),
        *[F.array(F.lit("s")).alias(c) for c in ("specific_issues", "general_issue_codes", "government_entities", "lobbied_bills")])
    written = []
    scratch = Scratch(spark, "test")
    parts = merge.split_lobbying(filings, lambda df: written.append(1) or scratch.keep(df))
    assert {name: df.count() for name, df in parts.items()} == {"registrant": 2, "client": 3, "filing": 7, "lobbyist": 14}
    assert len(written) == 2
    plain = merge.split_lobbying(filings)
    for name, df in parts.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, plain[name].collect()))
