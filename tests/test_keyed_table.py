"""The bucketed table: batches, replays, failures, untouched files, streams."""

import pytest
from pyspark.sql import functions as F

from filinglens.operators import merge
from filinglens.operators.keyed_table import KeyedTable
from filinglens.streaming import jobs

SCHEMA = "id long, k string, v long"


def insert(old, new):
    return merge.insert_new(old, new, ["k"], ["id"])


def upsert(old, new):
    return merge.upsert(old, new, ["k"], ["id"])


def got(table):
    return sorted(((r.id, r.k, r.v) for r in table.read().collect()), key=str)


def files(table):
    rows = table.read().select(F.input_file_name().alias("f")).distinct().collect()
    return {r.f.rsplit("/", 2)[1] + "/" + r.f.rsplit("/", 2)[2] for r in rows}


def test_batches_and_replay(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=16)
    assert got(table) == []
    first = spark.createDataFrame([(i, f"k{i % 40}", i) for i in range(60)] + [(100, None, 1)], SCHEMA)
    table.apply(first, insert, 0)
    want = sorted([(i, f"k{i}", i) for i in range(40)] + [(100, None, 1)], key=str)
    assert got(table) == want
    before = files(table)
    second = spark.createDataFrame([(200, "k3", -1), (201, "new", 5), (202, None, 2)], SCHEMA)
    touched = table.apply(second, insert, 1)
    want = sorted(want + [(201, "new", 5), (202, None, 2)], key=str)
    assert got(table) == want
    kept = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
    assert 0 < len(touched) <= 3 and kept and kept <= files(table)
    table.apply(second, insert, 1)  # the same batch again: rows without a key are not doubled
    assert got(table) == want
    table.apply(spark.createDataFrame([(300, "new", 9), (299, "new", 8)], SCHEMA), upsert, 2)
    assert got(table) == sorted([r for r in want if r[1] != "new"] + [(300, "new", 9)], key=str)
    assert table.apply(first.limit(0), upsert, 3) == []
    # opened again, the content is there
    assert got(KeyedTable(spark, table.path, SCHEMA, ["k"], buckets=16)) == got(table)


def test_failure_while_publishing(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=4)
    table.apply(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA), insert, 0)
    publish = KeyedTable._publish

    def broken(self, place):
        # some buckets are gone and nothing has taken their place
        for folder in (tmp_path / "t").glob("_bucket=*"):
            for file in folder.iterdir():
                file.unlink()
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "_publish", broken)
    # as many keys as it takes to hit every bucket
    batch = spark.createDataFrame([(3, k, 3) for k in [*"abcdefghijklmnopqrstuvwxyz", None]], SCHEMA)
    with pytest.raises(RuntimeError):
        table.apply(batch, insert, 1)
    monkeypatch.setattr(KeyedTable, "_publish", publish)
    assert len(table.apply(batch, insert, 1)) == 4
    assert [r[1] for r in got(table)].count("a") == 1 and len(got(table)) == 27 and (1, "a", 1) in got(table)


def test_plan_reads_only_touched_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=8)
    table.apply(spark.createDataFrame([(i, str(i), i) for i in range(100)], SCHEMA), insert, 0)
    plan = table.read([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan
    places = [r.b for r in table.read([1, 2]).select(table.bucket().alias("b")).distinct().collect()]
    assert sorted(places) == [1, 2]


def test_stream_resumes(spark, tmp_path):
    schema = "trade_id long, member_name string, ticker string, transaction_date date, transaction_type string, amount_range_low double"

    def land(name, rows):
        spark.createDataFrame(rows, "trade_id long, member_name string, ticker string, d string").select(
            "trade_id", "member_name", "ticker", F.to_date("d").alias("transaction_date"), F.lit("P").alias("transaction_type"),
            F.lit(1001.0).alias("amount_range_low")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = jobs.read_files(spark, str(tmp_path / "in"), schema)
        return jobs.stream_filings(stream, jobs.filings_table(spark, str(tmp_path / "t"), schema, 8), ["trade_id"])

    land("a", [(1, "m", "T", "2020-01-01"), (2, "m", "T", "2020-01-01"), (3, "m", None, "2020-01-01")])
    assert sorted(r.trade_id for r in run().read().collect()) == [1, 3]
    land("b", [(4, "m", "T", "2020-01-01"), (5, "m", "U", "2020-01-01"), (6, "m", None, "2020-01-01")])
    assert sorted(r.trade_id for r in run().read().collect()) == [1, 3, 5, 6]
    assert sorted(r.trade_id for r in run().read().collect()) == [1, 3, 5, 6]
