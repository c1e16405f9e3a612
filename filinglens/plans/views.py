"""Domain tables derived from the TPC-H-like driver tables.

``Tables`` gives each table of the data model as a lazy DataFrame. ``VIEW_SQL``
states the same derivations as DuckDB SQL; an oracle query names the views it
needs and gets them as common table expressions.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K

COMMITTEE_PREFIXES = list(K.COMMITTEE_KEYWORDS)[:25]
SECTORS = [
    "Technology", "Healthcare", "Financial Services", "Energy", "Utilities", "Industrials",
    "Consumer Defensive", "Communication Services", "Real Estate", "Agriculture", "",
]
AS_OF_DATE = "2001-08-01"       # just after the last trades
AS_OF_TIME = "2024-01-31 00:00:00"  # just after the last events
SINCE = "1995-01-01"            # training floor that fits the data
BENCH_TICKER = "Brand#1"        # plays the market benchmark


def pick(values: list, index: Column) -> Column:
    """values[index] with a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def committee_code(nation: Column) -> Column:
    return pick([p.lower() + "00" for p in COMMITTEE_PREFIXES], nation)


class Tables:
    """Lazy domain tables over one directory of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # keys and names compress a hundredfold: what AQE merges into one task by default (64 MB) takes gigabytes there
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4MB")
        # HotSpot never compiles a longer method: a step over the whole frame would run interpreted
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        lines = self.raw("lineitem").select(
            "l_partkey", F.to_date("l_shipdate").alias("date"), "l_quantity",
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        )
        parts = self.raw("part").select("p_partkey", F.col("p_brand").alias("ticker"))
        unit = F.col("cents") / 100.0 / F.col("l_quantity")
        return (
            lines.join(parts, lines.l_partkey == parts.p_partkey)
            .groupBy("ticker", "date")
            .agg(
                F.min(unit).alias("low"), F.max(unit).alias("high"),
                F.sum("cents").alias("cents"), F.sum("l_quantity").cast("long").alias("volume"),
            )
        )

    @cached_property
    def prices(self) -> DataFrame:
        price = F.col("cents") / 100.0 / F.col("volume")
        return self.bars.select(
            "ticker", "date", price.alias("adj_close"), price.alias("close"), "volume",
        )

    @cached_property
    def trades(self) -> DataFrame:
        first_part = self.raw("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("partkey"))
        parts = self.raw("part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
        o = self.raw("orders").join(first_part, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(
            parts, F.col("partkey") == F.col("p_partkey"), "left"
        )
        key, cust, total = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
        day = F.to_date("o_orderdate")
        priority = F.substring("o_orderpriority", 1, 1).cast("int")
        tier = F.when(total <= 15000, 0).when(total <= 50000, 1).when(total <= 100000, 2).when(
            total <= 250000, 3).otherwise(4)
        low = pick([lo for _, lo, _ in K.AMOUNT_RANGES[:5]], tier)
        high = pick([hi for _, _, hi in K.AMOUNT_RANGES[:5]], tier)
        status = F.col("o_orderstatus")
        first, last = given_name(cust), family_name(cust)
        return o.select(
            key.alias("trade_id"),
            F.when(cust % 20 != 0, cust.cast("string")).alias("member_bioguide_id"),
            F.when(cust % 2 == 0, F.concat(last, F.lit(", Hon.. "), first))
            .otherwise(F.concat(last, F.lit(", "), first)).alias("member_name"),
            pick(["member", "spouse", "dependent", "joint"], key % 4).alias("filer_type"),
            F.col("p_brand").alias("ticker"),
            F.concat_ws(" ", "p_name", "p_type").alias("asset_name"),
            F.when(F.col("p_size") % 10 == 1, "Stock Option").when(F.col("p_size") % 10 != 0, "Stock")
            .alias("asset_type"),
            F.when(status == "F", "purchase").when(status == "P", "exchange")
            .otherwise(pick(["sale_full", "sale_partial", "sale"], key % 3)).alias("transaction_type"),
            day.alias("transaction_date"),
            F.when(key % 11 != 0, F.date_add(day, priority * 10 - 5)).alias("disclosure_date"),
            F.when(key % 13 != 0, low).cast("double").alias("amount_range_low"),
            F.when(key % 13 != 0, high).cast("double").alias("amount_range_high"),
            F.when(cust % 2 == 0, "house").otherwise("senate").alias("chamber"),
            F.when(cust % 2 == 0, "house_clerk").otherwise("senate_csv").alias("source"),
            F.when(cust % 2 == 0, F.concat(F.lit("https://filings.example/"), (key % 500).cast("string")))
            .alias("filing_url"),
        )

    @cached_property
    def members(self) -> DataFrame:
        cust, nation = F.col("c_custkey"), F.col("c_nationkey")
        return self.raw("customer").select(
            cust.cast("string").alias("bioguide_id"),
            F.concat(given_name(cust), F.lit(" "), family_name(cust)).alias("full_name"),
            given_name(cust).alias("first_name"),
            F.when(cust % 10 != 0, family_name(cust)).alias("last_name"),
            F.when(nation % 2 == 1, "senate").otherwise("house").alias("chamber"),
            F.lpad(nation.cast("string"), 2, "0").alias("state"),
            F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Democratic")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "Democrat")
            .when(F.col("c_mktsegment") == "BUILDING", "Republican")
            .when(F.col("c_mktsegment") == "FURNITURE", "Independent").alias("party"),
            (cust % 3 != 0).alias("in_office"),
            F.when(cust % 9 != 0, 1980 + cust % 20).cast("int").alias("first_elected"),
            (F.col("c_acctbal") / 10000).alias("nominate_dim1"),
            F.when(cust % 7 != 0, -F.col("c_acctbal") / 20000).alias("nominate_dim2"),
        )

    @cached_property
    def committees(self) -> DataFrame:
        n = F.col("n_nationkey")
        code = committee_code(n)
        return self.raw("nation").select(
            code.alias("system_code"), F.col("n_name").alias("name"),
            F.when(code.startswith("h"), "house").otherwise("senate").alias("chamber"),
            (n % 5 != 4).alias("is_current"),
        )

    @cached_property
    def assignments(self) -> DataFrame:
        cust, nation = F.col("c_custkey"), F.col("c_nationkey")
        seat = lambda n, congress: F.struct(n.alias("n"), F.lit(congress).alias("congress_number"))
        return (
            self.raw("customer")
            .select(
                cust, F.explode(F.array(seat(nation, 118), seat((nation + 7) % 25, 118), seat(nation, 117))).alias("s")
            )
            .select(
                F.col("c_custkey").cast("string").alias("member_bioguide_id"),
                committee_code(F.col("s.n")).alias("committee_code"),
                F.concat(F.lit("Committee "), F.col("s.n").cast("string")).alias("committee_name"),
                F.when(F.col("c_custkey") % 50 == 0, "chair").when(F.col("c_custkey") % 50 == 1, "ranking")
                .otherwise("member").alias("role"),
                F.col("s.congress_number").alias("congress_number"),
            )
        )

    @cached_property
    def hearings(self) -> DataFrame:
        lines = self.raw("lineitem").filter("l_quantity >= 45 and l_linenumber = 1")
        s = self.raw("supplier").select("s_suppkey", "s_nationkey")
        day = F.to_date("l_shipdate")
        return (
            lines.join(s, lines.l_suppkey == s.s_suppkey)
            .select("s_nationkey", day.alias("hearing_date")).distinct()
            .select(
                (F.col("s_nationkey").cast("long") * 100000 + F.unix_date("hearing_date")).alias("hearing_id"),
                committee_code(F.col("s_nationkey")).alias("committee_code"),
                F.concat(F.lit("Hearing "), F.col("s_nationkey").cast("string")).alias("title"),
                "hearing_date",
            )
        )

    @cached_property
    def bills(self) -> DataFrame:
        key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
        o = self.raw("orders").filter("o_orderpriority = '1-URGENT'")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        ref = lambda n: F.struct(
            committee_code(n).alias("code"), F.concat(F.lit("Committee "), n.cast("string")).alias("name"))
        nation = F.col("c_nationkey")
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.concat(F.lit("hr"), key.cast("string"), F.lit("-118")).alias("bill_id"),
            F.lit(118).alias("congress_number"), F.lit("hr").alias("bill_type"),
            F.concat(F.lit("A bill numbered "), key.cast("string")).alias("title"),
            F.when(key % 10 != 0, day).alias("introduced_date"),
            F.date_add(day, 5).alias("latest_action_date"),
            F.when(key % 15 != 0, F.col("o_custkey").cast("string")).alias("sponsor_bioguide_id"),
            pick(["Health", "Energy policy", "Public Health", "Taxation", "Defense"], key % 5).alias("policy_area"),
            F.when(key % 4 == 0, F.array(ref(nation), ref((nation + 3) % 25))).otherwise(F.array(ref(nation)))
            .alias("committees"),
        )

    @cached_property
    def cosponsors(self) -> DataFrame:
        return self.raw("orders").filter("o_orderpriority = '1-URGENT'").select(
            F.concat(F.lit("hr"), F.col("o_orderkey").cast("string"), F.lit("-118")).alias("bill_id"),
            (F.col("o_custkey") + 1).cast("string").alias("member_bioguide_id"),
        )

    @cached_property
    def votes(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.raw("orders").filter("o_orderpriority = '2-HIGH'").select(
            key.alias("vote_id"), F.col("o_custkey").cast("string").alias("member_bioguide_id"),
            F.date_add(F.to_date("o_orderdate"), (key % 9 - 4).cast("int")).alias("vote_date"),
            F.when(key % 2 == 0, "yea").otherwise("nay").alias("position"),
            F.concat(F.lit("Question "), (key % 7).cast("string")).alias("question"),
            F.when(key % 3 == 0, "passed").otherwise("failed").alias("result"),
        )

    @cached_property
    def filings(self) -> DataFrame:
        parts = self.raw("part").select("p_partkey", "p_brand")
        l = self.raw("lineitem").select(
            "l_orderkey", "l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("day"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
        return (
            l.join(parts, l.l_partkey == parts.p_partkey)
            .groupBy("l_orderkey", "l_suppkey", "p_brand")
            .agg(F.sum("cents").alias("cents"), F.min("day").alias("filing_date"))
            .select(
                F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string"), "p_brand")
                .alias("filing_uuid"),
                F.col("l_suppkey").cast("string").alias("registrant_id"), F.col("p_brand").alias("client_id"),
                (F.col("cents") / 100.0).alias("amount"), "filing_date",
                F.year("filing_date").alias("filing_year"),
            )
        )

    @cached_property
    def registrants(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").cast("string").alias("senate_id"), F.col("s_name").alias("name"))

    @cached_property
    def clients(self) -> DataFrame:
        return self.raw("part").select("p_brand").distinct().select(
            F.col("p_brand").alias("client_id"), F.concat("p_brand", F.lit(" Holdings Inc")).alias("name"),
            F.when(F.col("p_brand") != "Brand#7", F.col("p_brand")).alias("matched_ticker"),
        )

    @cached_property
    def lobbyists(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            F.concat(F.lit("Lobbyist "), (key % 37).cast("string")).alias("name"),
            key.cast("string").alias("registrant_id"), key.cast("string").alias("former_member_id"),
            (key % 2 == 0).alias("is_former_congress"),
        )

    @cached_property
    def lobbied(self) -> DataFrame:
        l = self.raw("lineitem").filter("l_returnflag = 'R' and l_discount >= 0.09")
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        return l.join(o, l.l_orderkey == o.o_orderkey).select(
            F.col("l_suppkey").cast("string").alias("registrant_id"),
            F.col("o_custkey").cast("string").alias("member_bioguide_id"),
        ).distinct()

    @cached_property
    def campaign_committees(self) -> DataFrame:
        cust = F.col("c_custkey")
        return self.raw("customer").select(
            F.concat(F.lit("C"), cust.cast("string")).alias("fec_committee_id"),
            F.concat(F.lit("Friends of "), given_name(cust), F.lit(" "), family_name(cust)).alias("name"),
            F.when(cust % 6 != 0, cust.cast("string")).alias("member_bioguide_id"),
        )

    @cached_property
    def contributions(self) -> DataFrame:
        parts = self.raw("part").select("p_partkey", "p_brand")
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        l = self.raw("lineitem")
        return l.join(parts, l.l_partkey == parts.p_partkey).join(o, l.l_orderkey == o.o_orderkey).select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
            .alias("fec_transaction_id"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("fec_committee_id"),
            F.concat("p_brand", F.lit(" Corp")).alias("contributor_employer"),
            F.when(F.col("p_brand") != "Brand#9", F.col("p_brand")).alias("matched_ticker"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
            F.to_date("l_shipdate").alias("contribution_date"),
        )

    @cached_property
    def media(self) -> DataFrame:
        d = F.col("doc_id")
        return self.raw("documents").select(
            d.alias("media_id"), F.col("source").alias("source_type"), d.cast("string").alias("source_id"),
            F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"),
            F.date_add(F.lit("1995-01-01").cast("date"), (d * 7919 % 2400).cast("int")).alias("published_date"),
            F.array_distinct(F.array((d % 100).cast("string"), (d * 3 % 100).cast("string")))
            .alias("member_bioguide_ids"),
            F.array(F.concat(F.lit("Brand#"), (d % 25 + 1).cast("string"))).alias("tickers_mentioned"),
        )

    @cached_property
    def sentiment(self) -> DataFrame:
        confidence = F.lit(0.5) + (F.col("doc_id") % 50) / 100.0
        return self.raw("labels").select(
            F.col("doc_id").alias("media_id"), F.lit("wordlist").alias("model_name"),
            F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
            .otherwise("neutral").alias("sentiment_label"),
            F.when(F.col("toxic") == 1, -confidence).when(F.col("quality") == 1, confidence)
            .otherwise(0.0).alias("sentiment_score"),
            confidence.alias("confidence"),
        )

    @cached_property
    def signals(self) -> DataFrame:
        e, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
        k = F.get_json_object("props", "$.k").cast("int")
        strength = F.least(F.col("value") / 100.0, F.lit(1.0))
        ts = F.col("ts").cast("timestamp")
        return self.raw("events").select(
            e.alias("signal_id"),
            F.when(kind == "click", "trade_follow").when(kind == "view", "anomaly_alert")
            .when(kind == "signup", "sentiment_divergence").otherwise("insider_cluster").alias("signal_type"),
            F.when(kind != "purchase", user.cast("string")).alias("member_bioguide_id"),
            F.when(e % 31 != 0, F.concat(F.lit("Brand#"), (user % 25 + 1).cast("string"))).alias("ticker"),
            F.when(kind == "error", "bearish").when(kind == "view", "neutral").otherwise("bullish").alias("direction"),
            strength.alias("strength"), (strength * 0.9).alias("confidence"),
            ts.alias("created_at"),
            F.when(e % 17 != 0, ts + F.expr("interval 7 days")).alias("expires_at"),
            (k % 5 != 0).alias("is_active"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        key = F.col("o_orderkey")
        value = (key * 37 % 1000) / 1000.0
        kinds = F.array(*[
            F.struct(F.lit(i).alias("artifact_id"), F.lit(kind).alias("prediction_type"))
            for i, kind in enumerate(["profitability", "return_5d", "anomaly"], start=1)])
        o = self.raw("orders").select("o_orderkey", "o_orderdate", F.explode(kinds).alias("m"))
        kind = F.col("m.prediction_type")
        return o.filter(~((kind == "anomaly") & (key % 5 == 0))).select(
            (key * 10 + F.col("m.artifact_id")).alias("prediction_id"), key.alias("trade_id"),
            F.col("m.artifact_id").alias("artifact_id"), kind.alias("prediction_type"),
            value.alias("predicted_value"),
            F.when(kind == "profitability", F.when(value > 0.5, "profitable").otherwise("unprofitable"))
            .when(kind == "return_5d", F.when(value > 0.5, "positive").otherwise("negative"))
            .otherwise(F.when(value > 0.9, "anomalous").otherwise("normal")).alias("predicted_label"),
            F.when(kind == "anomaly", value).otherwise(F.abs(value - 0.5) * 2).alias("confidence"),
            F.when((kind == "profitability") & (key % 4 != 0), (key * 53 % 2000 - 1000) / 10000.0)
            .alias("actual_return_5d"),
            F.to_timestamp(F.to_date("o_orderdate")).alias("created_at"),
        )

    @cached_property
    def artifacts(self) -> DataFrame:
        r = self.raw("region").select("r_regionkey", F.col("r_name").alias("model_name"))
        n = F.col("n_nationkey")
        return self.raw("nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
            n.alias("artifact_id"), "model_name", F.concat(F.lit("v"), n.cast("string")).alias("model_version"),
            (n / 100.0).alias("auc"),
            F.date_add(F.lit("2024-01-01").cast("date"), (n * 7 % 13).cast("int")).alias("trained_at"),
            (n % 2 == 0).alias("is_active"),
        )

    @cached_property
    def alert_configs(self) -> DataFrame:
        n = F.col("n_nationkey")
        text = lambda c: F.concat(F.lit("Brand#"), c.cast("string"))
        none = F.array().cast("array<string>")
        return self.raw("nation").select(
            n.cast("long").alias("config_id"), F.col("n_name").alias("name"),
            F.when(n % 3 == 0, none).otherwise(F.array(F.lit("trade_follow"), F.lit("insider_cluster")))
            .alias("signal_types"),
            (n % 4 * 0.25).alias("min_strength"),
            F.when(n % 5 == 0, none).otherwise(F.array(text(n + 1), text((n + 5) % 25 + 1))).alias("tickers"),
            F.when(n % 7 != 0, none).otherwise(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i.cast("string")))
            .alias("members"),
            (n % 6 != 5).alias("is_active"),
        )

    @cached_property
    def sectors(self) -> DataFrame:
        brand_no = F.split("p_brand", "#")[1].cast("int")
        return self.raw("part").filter("p_brand <> 'Brand#5'").select("p_brand").distinct().select(
            F.col("p_brand").alias("ticker"), pick(SECTORS, brand_no % len(SECTORS)).alias("sector"))


def given_name(key: Column) -> Column:
    return F.concat(F.lit("Given"), (key % 23).cast("string"))


def family_name(key: Column) -> Column:
    return F.concat(F.lit("Family"), (key % 311).cast("string"))


# --------------------------------------------------------------------------- SQL

_CODES = "[" + ",".join(f"'{p.lower()}00'" for p in COMMITTEE_PREFIXES) + "]"
_SECTORS = "[" + ",".join(f"'{s}'" for s in SECTORS) + "]"


def code_sql(expr: str) -> str:
    return f"{_CODES}[CAST({expr} AS BIGINT) + 1]"


def _given(k: str) -> str:
    return f"'Given' || ({k} % 23)"


def _family(k: str) -> str:
    return f"'Family' || ({k} % 311)"


VIEW_SQL = {
    "bars": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
        min(CAST(round(l_extendedprice*100) AS BIGINT)::DOUBLE/100.0::DOUBLE/l_quantity) AS low,
        max(CAST(round(l_extendedprice*100) AS BIGINT)::DOUBLE/100.0::DOUBLE/l_quantity) AS high,
        CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS cents,
        CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "prices": """SELECT ticker, date, cents::DOUBLE/100.0::DOUBLE/volume AS adj_close,
        cents::DOUBLE/100.0::DOUBLE/volume AS close, volume FROM bars""",
    "trades": f"""SELECT o_orderkey AS trade_id,
        CASE WHEN o_custkey % 20 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS member_bioguide_id,
        CASE WHEN o_custkey % 2 = 0 THEN {_family('o_custkey')} || ', Hon.. ' || {_given('o_custkey')}
             ELSE {_family('o_custkey')} || ', ' || {_given('o_custkey')} END AS member_name,
        ['member','spouse','dependent','joint'][o_orderkey % 4 + 1] AS filer_type,
        p_brand AS ticker, concat_ws(' ', p_name, p_type) AS asset_name,
        CASE WHEN p_size % 10 = 1 THEN 'Stock Option' WHEN p_size % 10 <> 0 THEN 'Stock' END AS asset_type,
        CASE o_orderstatus WHEN 'F' THEN 'purchase' WHEN 'P' THEN 'exchange'
             ELSE ['sale_full','sale_partial','sale'][o_orderkey % 3 + 1] END AS transaction_type,
        CAST(o_orderdate AS DATE) AS transaction_date,
        CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE)
             + (CAST(left(o_orderpriority,1) AS INTEGER)*10 - 5) END AS disclosure_date,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(CASE WHEN o_totalprice <= 15000 THEN 1001 WHEN o_totalprice <= 50000
             THEN 15001 WHEN o_totalprice <= 100000 THEN 50001 WHEN o_totalprice <= 250000 THEN 100001
             ELSE 250001 END AS DOUBLE) END AS amount_range_low,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(CASE WHEN o_totalprice <= 15000 THEN 15000 WHEN o_totalprice <= 50000
             THEN 50000 WHEN o_totalprice <= 100000 THEN 100000 WHEN o_totalprice <= 250000 THEN 250000
             ELSE 500000 END AS DOUBLE) END AS amount_range_high,
        CASE WHEN o_custkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber,
        CASE WHEN o_custkey % 2 = 0 THEN 'house_clerk' ELSE 'senate_csv' END AS source,
        CASE WHEN o_custkey % 2 = 0 THEN 'https://filings.example/' || (o_orderkey % 500) END AS filing_url
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS partkey FROM lineitem GROUP BY 1) fp
          ON o_orderkey = l_orderkey LEFT JOIN part ON partkey = p_partkey""",
    "members": f"""SELECT CAST(c_custkey AS VARCHAR) AS bioguide_id,
        {_given('c_custkey')} || ' ' || {_family('c_custkey')} AS full_name, {_given('c_custkey')} AS first_name,
        CASE WHEN c_custkey % 10 <> 0 THEN {_family('c_custkey')} END AS last_name,
        CASE WHEN c_nationkey % 2 = 1 THEN 'senate' ELSE 'house' END AS chamber,
        lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Democratic' WHEN 'HOUSEHOLD' THEN 'Democrat'
             WHEN 'BUILDING' THEN 'Republican' WHEN 'FURNITURE' THEN 'Independent' END AS party,
        c_custkey % 3 <> 0 AS in_office,
        CASE WHEN c_custkey % 9 <> 0 THEN CAST(1980 + c_custkey % 20 AS INTEGER) END AS first_elected,
        c_acctbal / 10000 AS nominate_dim1,
        CASE WHEN c_custkey % 7 <> 0 THEN -c_acctbal / 20000 END AS nominate_dim2 FROM customer""",
    "committees": f"""SELECT {code_sql('n_nationkey')} AS system_code, n_name AS name,
        CASE WHEN left({code_sql('n_nationkey')},1) = 'h' THEN 'house' ELSE 'senate' END AS chamber,
        n_nationkey % 5 <> 4 AS is_current FROM nation""",
    "assignments": f"""SELECT CAST(c_custkey AS VARCHAR) AS member_bioguide_id, {code_sql('n')} AS committee_code,
        'Committee ' || n AS committee_name,
        CASE WHEN c_custkey % 50 = 0 THEN 'chair' WHEN c_custkey % 50 = 1 THEN 'ranking' ELSE 'member' END AS role,
        congress_number FROM (
          SELECT c_custkey, c_nationkey AS n, 118 AS congress_number FROM customer UNION ALL
          SELECT c_custkey, (c_nationkey + 7) % 25, 118 FROM customer UNION ALL
          SELECT c_custkey, c_nationkey, 117 FROM customer)""",
    "hearings": f"""SELECT DISTINCT CAST(s_nationkey AS BIGINT) * 100000
          + (CAST(l_shipdate AS DATE) - DATE '1970-01-01') AS hearing_id,
        {code_sql('s_nationkey')} AS committee_code, 'Hearing ' || s_nationkey AS title,
        CAST(l_shipdate AS DATE) AS hearing_date
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45 AND l_linenumber = 1""",
    "bills": """SELECT 'hr' || o_orderkey || '-118' AS bill_id, 118 AS congress_number, 'hr' AS bill_type,
        'A bill numbered ' || o_orderkey AS title,
        CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS introduced_date,
        CAST(o_orderdate AS DATE) + 5 AS latest_action_date,
        CASE WHEN o_orderkey % 15 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS sponsor_bioguide_id,
        ['Health','Energy policy','Public Health','Taxation','Defense'][o_orderkey % 5 + 1] AS policy_area,
        c_nationkey AS n1, CASE WHEN o_orderkey % 4 = 0 THEN (c_nationkey + 3) % 25 END AS n2
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""",
    "bill_committees": f"""SELECT bill_id, {code_sql('n1')} AS code FROM bills UNION ALL
        SELECT bill_id, {code_sql('n2')} FROM bills WHERE n2 IS NOT NULL""",
    "cosponsors": """SELECT 'hr' || o_orderkey || '-118' AS bill_id,
        CAST(o_custkey + 1 AS VARCHAR) AS member_bioguide_id FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "votes": """SELECT o_orderkey AS vote_id, CAST(o_custkey AS VARCHAR) AS member_bioguide_id,
        CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 4 AS INTEGER) AS vote_date,
        CASE WHEN o_orderkey % 2 = 0 THEN 'yea' ELSE 'nay' END AS position,
        'Question ' || (o_orderkey % 7) AS question,
        CASE WHEN o_orderkey % 3 = 0 THEN 'passed' ELSE 'failed' END AS result
        FROM orders WHERE o_orderpriority = '2-HIGH'""",
    "filings": """SELECT l_orderkey || '-' || l_suppkey || '-' || p_brand AS filing_uuid,
        CAST(l_suppkey AS VARCHAR) AS registrant_id, p_brand AS client_id,
        sum(CAST(round(l_extendedprice*100) AS BIGINT))::DOUBLE / 100.0::DOUBLE AS amount,
        min(CAST(l_shipdate AS DATE)) AS filing_date, year(min(CAST(l_shipdate AS DATE))) AS filing_year
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_suppkey, p_brand""",
    "registrants": "SELECT CAST(s_suppkey AS VARCHAR) AS senate_id, s_name AS name FROM supplier",
    "clients": """SELECT DISTINCT p_brand AS client_id, p_brand || ' Holdings Inc' AS name,
        CASE WHEN p_brand <> 'Brand#7' THEN p_brand END AS matched_ticker FROM part""",
    "lobbyists": """SELECT 'Lobbyist ' || (s_suppkey % 37) AS name, CAST(s_suppkey AS VARCHAR) AS registrant_id,
        CAST(s_suppkey AS VARCHAR) AS former_member_id, s_suppkey % 2 = 0 AS is_former_congress FROM supplier""",
    "lobbied": """SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS registrant_id,
        CAST(o_custkey AS VARCHAR) AS member_bioguide_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'R' AND l_discount >= 0.09::DOUBLE""",
    "campaign_committees": f"""SELECT 'C' || c_custkey AS fec_committee_id,
        'Friends of ' || {_given('c_custkey')} || ' ' || {_family('c_custkey')} AS name,
        CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS member_bioguide_id FROM customer""",
    "contributions": """SELECT l_orderkey || '-' || l_linenumber AS fec_transaction_id,
        'C' || o_custkey AS fec_committee_id, p_brand || ' Corp' AS contributor_employer,
        CASE WHEN p_brand <> 'Brand#9' THEN p_brand END AS matched_ticker,
        CAST(round(l_extendedprice*100) AS BIGINT) AS cents, CAST(l_shipdate AS DATE) AS contribution_date
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "media": """SELECT doc_id AS media_id, source AS source_type, CAST(doc_id AS VARCHAR) AS source_id,
        substr(text, 1, 40) AS title, text AS content,
        DATE '1995-01-01' + CAST(doc_id * 7919 % 2400 AS INTEGER) AS published_date,
        list_distinct([CAST(doc_id % 100 AS VARCHAR), CAST(doc_id * 3 % 100 AS VARCHAR)]) AS member_bioguide_ids,
        ['Brand#' || (doc_id % 25 + 1)] AS tickers_mentioned FROM documents""",
    "sentiment": """SELECT doc_id AS media_id, 'wordlist' AS model_name,
        CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment_label,
        CASE WHEN toxic = 1 THEN -(0.5::DOUBLE + (doc_id % 50) / 100.0::DOUBLE)
             WHEN quality = 1 THEN 0.5::DOUBLE + (doc_id % 50) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS sentiment_score,
        0.5::DOUBLE + (doc_id % 50) / 100.0::DOUBLE AS confidence FROM labels""",
    "signals": """SELECT event_id AS signal_id,
        CASE event_type WHEN 'click' THEN 'trade_follow' WHEN 'view' THEN 'anomaly_alert'
             WHEN 'signup' THEN 'sentiment_divergence' ELSE 'insider_cluster' END AS signal_type,
        CASE WHEN event_type <> 'purchase' THEN CAST(user_id AS VARCHAR) END AS member_bioguide_id,
        CASE WHEN event_id % 31 <> 0 THEN 'Brand#' || (user_id % 25 + 1) END AS ticker,
        CASE event_type WHEN 'error' THEN 'bearish' WHEN 'view' THEN 'neutral' ELSE 'bullish' END AS direction,
        least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS strength,
        least(value / 100.0::DOUBLE, 1.0::DOUBLE) * 0.9::DOUBLE AS confidence,
        ts AS created_at, CASE WHEN event_id % 17 <> 0 THEN ts + INTERVAL 7 DAY END AS expires_at,
        CAST(json_extract(props, '$.k') AS INTEGER) % 5 <> 0 AS is_active FROM events""",
    "predictions": """SELECT o_orderkey * 10 + artifact_id AS prediction_id, o_orderkey AS trade_id, artifact_id,
        prediction_type, v AS predicted_value,
        CASE prediction_type WHEN 'profitability' THEN CASE WHEN v > 0.5 THEN 'profitable' ELSE 'unprofitable' END
             WHEN 'return_5d' THEN CASE WHEN v > 0.5 THEN 'positive' ELSE 'negative' END
             ELSE CASE WHEN v > 0.9 THEN 'anomalous' ELSE 'normal' END END AS predicted_label,
        CASE WHEN prediction_type = 'anomaly' THEN v ELSE abs(v - 0.5::DOUBLE) * 2 END AS confidence,
        CASE WHEN prediction_type = 'profitability' AND o_orderkey % 4 <> 0
             THEN (o_orderkey * 53 % 2000 - 1000) / 10000.0::DOUBLE END AS actual_return_5d,
        CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS created_at
        FROM (SELECT o_orderkey, o_orderdate, (o_orderkey * 37 % 1000) / 1000.0::DOUBLE AS v FROM orders) o
        CROSS JOIN (VALUES (1, 'profitability'), (2, 'return_5d'), (3, 'anomaly')) m(artifact_id, prediction_type)
        WHERE NOT (prediction_type = 'anomaly' AND o_orderkey % 5 = 0)""",
    "artifacts": """SELECT n_nationkey AS artifact_id, r_name AS model_name, 'v' || n_nationkey AS model_version,
        n_nationkey / 100.0::DOUBLE AS auc, DATE '2024-01-01' + CAST(n_nationkey * 7 % 13 AS INTEGER) AS trained_at,
        n_nationkey % 2 = 0 AS is_active FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "alert_configs": """SELECT CAST(n_nationkey AS BIGINT) AS config_id, n_name AS name,
        CASE WHEN n_nationkey % 3 = 0 THEN []::VARCHAR[] ELSE ['trade_follow','insider_cluster'] END AS signal_types,
        n_nationkey % 4 * 0.25::DOUBLE AS min_strength,
        CASE WHEN n_nationkey % 5 = 0 THEN []::VARCHAR[]
             ELSE ['Brand#' || (n_nationkey + 1), 'Brand#' || ((n_nationkey + 5) % 25 + 1)] END AS tickers,
        CASE WHEN n_nationkey % 7 <> 0 THEN []::VARCHAR[]
             ELSE [CAST(i AS VARCHAR) for i in range(1, 51)] END AS members,
        n_nationkey % 6 <> 5 AS is_active FROM nation""",
    "sectors": f"""SELECT DISTINCT p_brand AS ticker,
        {_SECTORS}[CAST(split_part(p_brand, '#', 2) AS INTEGER) % {len(SECTORS)} + 1] AS sector
        FROM part WHERE p_brand <> 'Brand#5'""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the view definitions it uses, in dependency order."""
    views = {**VIEW_SQL, **(extra or {})}
    ordered: list[str] = []

    def visit_once(text: str) -> None:
        for name in views:
            if re.search(rf"(?i)\b(from|join)\s+{name}\b", text) and name not in ordered:
                visit_once(views[name])
                if name not in ordered:
                    ordered.append(name)

    visit_once(sql)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({views[name]})" for name in ordered)
    recursive = sql.startswith("WITH RECURSIVE ")
    if recursive:
        return f"WITH RECURSIVE {ctes},\n{sql.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {ctes}\n{sql}"
