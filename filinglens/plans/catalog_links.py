"""Scalar functions, keyed merges, linking and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..operators import merge, resolve
from ..operators.keyed_table import KeyedTable
from ..session import Scratch
from ..streaming.jobs import new_folder
from .catalog_sources import HTML_SQL, normalised_lobbying
from .registry import R, S, flat, query
from .views import Tables


# ---------------------------------------------------------------- X functions

KIND_SQL = """CASE WHEN contains(x, 'purchase') THEN 'purchase' WHEN contains(x, 'sale') THEN
    CASE WHEN contains(x, 'full') THEN 'sale_full' WHEN contains(x, 'partial') THEN 'sale_partial' ELSE 'sale' END
    WHEN contains(x, 'exchange') THEN 'exchange' ELSE x END"""


def _kind_text():
    return F.concat(F.when(F.col("trade_id") % 3 == 0, "  Stock ").otherwise(""), F.upper(
        F.replace("transaction_type", F.lit("_"), F.lit(" ("))))


@query("x01_tx_type", f"""SELECT trade_id, {KIND_SQL} AS kind FROM (SELECT trade_id, lower(trim(
    CASE WHEN trade_id % 3 = 0 THEN '  Stock ' ELSE '' END || upper(replace(transaction_type, '_', ' (')))) AS x FROM trades)""")
def _(t):
    return t.trades.select("trade_id", X.tx_type(_kind_text()).alias("kind"))


@query("x02_filer_type", """SELECT trade_id, filer_type AS filer FROM trades""")
def _(t):
    owner = F.when(F.col("filer_type") == "dependent", "Dependent CHILD").otherwise(F.initcap("filer_type"))
    return t.trades.select("trade_id", X.filer_type(owner).alias("filer"))


@query("x03_parse_date", f"""SELECT trade_id, CASE WHEN trade_id % 5 <> 4 THEN {S('transaction_date')} END AS day FROM trades""")
def _(t):
    k, d = F.col("trade_id"), F.col("transaction_date")
    text = (
        F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(d, "MM/dd/yyyy"))
        .when(k % 5 == 2, F.date_format(d, "MM-dd-yyyy")).when(k % 5 == 3, F.date_format(d, " MM/dd/yy")).otherwise("soon"))
    return flat(t.trades.select("trade_id", X.parse_date(text, (X.ISO, X.US, X.US_DASH, X.US_SHORT)).alias("day")))


@query("x04_parse_money", f"SELECT o_orderkey, {R('round(o_totalprice * 100) / 100')} AS amount FROM orders")
def _(t):
    text = F.concat(F.lit("$"), F.format_number(F.col("o_totalprice"), 2), F.lit(" "))
    return flat(t.raw("orders").select("o_orderkey", X.parse_money(text).alias("amount")))


@query("x05_amount_bounds", f"SELECT trade_id, {R('amount_range_low')} AS low, {R('amount_range_high')} AS high FROM trades")
def _(t):
    label = None
    for text, low, _ in K.AMOUNT_RANGES:
        hit = F.col("amount_range_low") == low
        label = F.when(hit, text) if label is None else label.when(hit, text)
    return flat(t.trades.select("trade_id", X.amount_bounds(label).alias("b")).select("trade_id", "b.low", "b.high"))


@query("x06_clean_ticker", "SELECT trade_id, CASE WHEN trade_id % 4 = 0 THEN ticker END AS ticker FROM trades")
def _(t):
    k = F.col("trade_id")
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), "ticker")).when(k % 4 == 1, "--").when(k % 4 == 2, " N/A ").otherwise(" ")
    return t.trades.select("trade_id", X.clean_ticker(text).alias("ticker"))


@query("x07_scrub", "SELECT p_partkey, p_name AS name FROM part")
def _(t):
    return t.raw("part").select("p_partkey", X.scrub(F.concat(F.lit("\u0000"), F.replace(
        "p_name", F.lit(" "), F.lit("\u0000 \u0000")))).alias("name"))


COMPANY_WORDS = ["Inc.", "& Co", "Technologies Group", "HOLDINGS plc", "of the North"]
# the word pattern also eats a leading "co", so "cold" becomes "ld"
COMPANY_SQL = """replace(lower(p_name), 'cold', 'ld') || CASE p_partkey % 5 WHEN 4 THEN ' north' ELSE '' END"""


def _company():
    return F.concat(F.initcap("p_name"), F.lit(", "), F.element_at(
        F.array(*[F.lit(w) for w in COMPANY_WORDS]), (F.col("p_partkey") % 5 + 1).cast("int")))


@query("x08_normalise_company", f"SELECT p_partkey, {COMPANY_SQL} AS name FROM part")
def _(t):
    return t.raw("part").select("p_partkey", X.normalise_company(_company()).alias("name"))


@query("x09_strip_html", f"SELECT page_id, {HTML_SQL} AS text FROM pages")
def _(t):
    return t.raw("pages").select("page_id", X.strip_html("html").alias("text"))


STOP_SQL = "[" + ",".join(f"'{w}'" for w in K.MENTION_STOP_WORDS) + "]"
MENTION_VIEW = {"mentions": f"""SELECT doc_id, list_filter(list_distinct_ordered, lambda w: NOT list_contains({STOP_SQL}, w)) AS words
    FROM (SELECT doc_id, list_transform(list_filter(list_zip(range(1, len(l) + 1), l),
            lambda z: list_position(l, z[2]) = z[1]), lambda z: z[2]) AS list_distinct_ordered
      FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'q', 'g'),
            '\\$?([A-Z]{{1,5}})\\b', 1) AS l FROM documents))"""}


@query("x10_ticker_mentions", """SELECT doc_id, array_to_string(words, ',') AS words,
    array_to_string(list_filter(words, lambda w: list_contains(['DE','EL','HA','IT'], w)), ',') AS known FROM mentions""", MENTION_VIEW)
def _(t):
    return flat(t.raw("documents").select(
        "doc_id", X.ticker_mentions("text").alias("words"), X.ticker_mentions("text", ["DE", "EL", "HA", "IT"]).alias("known")))


@query("x11_bill_refs", """SELECT o_orderkey, 'H.R. ' || (o_orderkey % 1000) || ',S.' || (o_orderkey % 77) || ',hr'
    || (o_orderkey % 9) || ',H.J.Res. 7' AS refs FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("On H.R. "), (k % 1000).cast("string"), F.lit(" and S."), (k % 77).cast("string"), F.lit("; also hr"),
        (k % 9).cast("string"), F.lit(" H.J.Res. 7 but not HB 12"))
    return flat(t.raw("orders").select("o_orderkey", X.bill_refs(text).alias("refs")))


@query("x12_former_flags", """SELECT s_suppkey, s_suppkey % 4 IN (0, 2) AS congress, s_suppkey % 4 IN (1, 2) AS executive FROM supplier""")
def _(t):
    text = F.element_at(F.array(
        F.lit("Chief of Staff, Rep. X"), F.lit("Department of Energy"), F.lit("Senate; White House fellow"), F.lit("None")),
        (F.col("s_suppkey") % 4 + 1).cast("int"))
    return t.raw("supplier").select("s_suppkey", X.former_flags(text).alias("f")).select(
        "s_suppkey", F.col("f.is_former_congress").alias("congress"), F.col("f.is_former_executive").alias("executive"))


@query("x13_lobbyist_name", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Given' || (c_custkey % 23) || ' Lee'
    WHEN 1 THEN 'Ms.  Lee' ELSE 'Unknown' END AS name FROM customer""")
def _(t):
    k = F.col("c_custkey")
    first = F.when(k % 3 == 0, F.concat(F.lit("Given"), (k % 23).cast("string")))
    return t.raw("customer").select("c_custkey", X.lobbyist_name(
        first, F.when(k % 3 <= 1, "Lee"), F.when(k % 3 == 1, "Ms.")).alias("name"))


@query("x14_split_member_name", """SELECT trade_id, CASE WHEN trade_id % 10 <> 0 THEN split_part(member_name, ', ', 1) END AS last,
    CASE WHEN trade_id % 10 <> 0 THEN replace(split_part(member_name, ', ', 2), 'Hon.. ', '') END AS first FROM trades""")
def _(t):
    k = F.col("trade_id")
    name = F.when(k % 10 == 0, "Alabama").when(k % 10 == 1, F.concat("member_name", F.lit(" Jr."))).when(
        k % 10 == 2, F.concat("member_name", F.lit("."))).otherwise(F.col("member_name"))
    return t.trades.select("trade_id", X.split_member_name(name).alias("n")).select("trade_id", "n.last", "n.first")


@query("x15_truncate", "SELECT doc_id, left(text, 100) AS head FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", X.truncate("text", 100).alias("head"))


@query("x16_session_number", "SELECT trade_id, (year(transaction_date) - 1789) // 2 + 1 AS session FROM trades")
def _(t):
    return t.trades.select("trade_id", X.session_number("transaction_date").cast("long").alias("session"))


@query("x17_fold_role", "SELECT member_bioguide_id, committee_code, congress_number, role FROM assignments")
def _(t):
    text = F.when(F.col("role") == "chair", "Vice Chairman").when(F.col("role") == "ranking", "Ranking Chair").otherwise("")
    return t.assignments.select("member_bioguide_id", "committee_code", "congress_number", X.fold_role(text).alias("role"))


# ---------------------------------------------------------------- merges

# existing rows: trades up to 1998; staged: all trades and a late copy of each
TRADE_KEYS = ["member_name", "ticker", "transaction_date", "transaction_type", "amount_range_low"]


@query("m01_insert_new_trades", """SELECT trade_id FROM (SELECT *, row_number() OVER (PARTITION BY member_name, ticker,
      transaction_date, transaction_type, amount_range_low ORDER BY (year(transaction_date) >= 1998), trade_id) AS rn,
      bool_or(year(transaction_date) < 1998) OVER (PARTITION BY member_name, ticker, transaction_date, transaction_type,
        amount_range_low) AS had FROM trades)
    WHERE year(transaction_date) < 1998 OR ticker IS NULL OR amount_range_low IS NULL OR (rn = 1 AND NOT had)
    UNION ALL SELECT trade_id + 1000000000 FROM trades WHERE ticker IS NULL OR amount_range_low IS NULL""")
def _(t):
    target = t.trades.filter("year(transaction_date) < 1998")
    late = t.trades.withColumn("trade_id", F.col("trade_id") + 1000000000)
    # existing null-key rows are staged once more as late copies only
    fresh = t.trades.filter("year(transaction_date) >= 1998")
    return merge.insert_new(target, fresh.unionByName(late), TRADE_KEYS, ["trade_id"]).select("trade_id")


@query("m02_insert_new_prices", f"SELECT ticker, {S('date')} AS date, {R('adj_close')} AS adj_close FROM prices")
def _(t):
    target = t.prices.filter("month(date) <= 6")
    staged = t.prices.withColumn("adj_close", F.when(F.month("date") <= 6, -1.0).otherwise(F.col("adj_close")))
    again = t.prices.filter("month(date) > 6").withColumn("adj_close", F.col("adj_close") + 1)
    return flat(merge.insert_new(target, staged.unionByName(again), ["ticker", "date"], ["adj_close"]),
                "ticker", "date", "adj_close")


@query("m03_upsert_members", """SELECT bioguide_id, CASE WHEN CAST(bioguide_id AS BIGINT) % 2 = 0 THEN 'New' ELSE party END AS party,
    state FROM members""")
def _(t):
    staged = t.members.filter("cast(bioguide_id as long) % 2 = 0").select("bioguide_id", F.lit("New").alias("party"))
    old = staged.withColumn("party", F.lit("Older"))
    both = staged.withColumn("seq", F.lit(2)).unionByName(old.withColumn("seq", F.lit(1)))
    return merge.upsert(t.members, both, ["bioguide_id"], ["seq"]).select("bioguide_id", "party", "state")


@query("m04_upsert_ideology", f"""SELECT bioguide_id, CASE WHEN CAST(bioguide_id AS BIGINT) % 3 <> 0 THEN party ELSE 'Staged' END AS party,
    {R('''CASE WHEN CAST(bioguide_id AS BIGINT) % 2 = 0 OR CAST(bioguide_id AS BIGINT) % 3 = 0 THEN 0.25 ELSE nominate_dim1 END''')} AS nominate_dim1
    FROM members WHERE CAST(bioguide_id AS BIGINT) % 3 <> 0 OR CAST(bioguide_id AS BIGINT) % 2 = 0 OR true""")
def _(t):
    number = F.col("bioguide_id").cast("long")
    target = t.members.filter(number % 3 != 0)
    staged = t.members.filter((number % 2 == 0) | (number % 3 == 0)).select(
        "bioguide_id", "full_name", "chamber", F.lit("Staged").alias("party"), F.lit(0.25).alias("nominate_dim1"),
        F.lit(0.5).alias("nominate_dim2"))
    out = merge.upsert(target, staged, ["bioguide_id"], ["full_name"], ["nominate_dim1", "nominate_dim2"])
    return flat(out, "bioguide_id", "party", "nominate_dim1")


@query("m05_upsert_bills", f"""SELECT bill_id, title, CASE WHEN sponsor_bioguide_id IS NULL THEN NULL ELSE 'S' || sponsor_bioguide_id END
    AS sponsor_bioguide_id, {S('introduced_date')} AS introduced_date FROM bills""")
def _(t):
    # the sponsor is overwritten, null included; title and introduction are frozen
    target = t.bills.withColumn("sponsor_bioguide_id", F.lit("old"))
    staged = t.bills.withColumn("title", F.lit("changed")).withColumn("introduced_date", F.lit(None).cast("date")).withColumn(
        "sponsor_bioguide_id", F.concat(F.lit("S"), "sponsor_bioguide_id"))
    out = merge.upsert(target, staged, ["bill_id"], ["title"], ["sponsor_bioguide_id", "committees", "latest_action_date"])
    return flat(out, "bill_id", "title", "sponsor_bioguide_id", "introduced_date")


@query("m06_upsert_committees", """SELECT system_code, name || '!' AS name, chamber FROM committees""")
def _(t):
    target = t.committees.filter("chamber = 'house'")
    staged = t.committees.withColumn("name", F.concat("name", F.lit("!")))
    return merge.upsert(target, staged, ["system_code"], ["name"], ["name", "chamber", "is_current"]).select(
        "system_code", "name", "chamber")


@query("m07_insert_new_hearings", "SELECT hearing_id, title FROM hearings UNION ALL SELECT -hearing_id, title FROM hearings WHERE hearing_id % 10 = 0")
def _(t):
    target = t.hearings.filter("hearing_id % 2 = 0")
    copies = t.hearings.withColumn("hearing_id", -F.col("hearing_id"))
    undated = copies.filter("hearing_id % 10 = 0").withColumn("hearing_date", F.lit(None).cast("date"))
    staged = t.hearings.filter("hearing_id % 2 <> 0").unionByName(
        copies.filter("hearing_id % 2 = 0 and hearing_id % 10 <> 0")).unionByName(undated)
    return merge.insert_new(target, staged, ["committee_code", "title", "hearing_date"], ["hearing_id"]).select(
        "hearing_id", "title")


@query("m08_split_lobbying", """SELECT 'client' AS part, count(DISTINCT client_id) AS n FROM filings
    UNION ALL SELECT 'filing', count(*) FROM filings
    UNION ALL SELECT 'filing_linked', count(*) FROM filings
    UNION ALL SELECT 'lobbyist', 2 * count(*) FROM filings
    UNION ALL SELECT 'registrant', count(DISTINCT registrant_id) FROM filings""")
def _(t):
    parts = merge.split_lobbying(normalised_lobbying(t), Scratch(t.spark, "lobbying").keep)
    linked = (
        parts["filing"].join(parts["client"].select(F.col("id").alias("client_id")), "client_id")
        .join(parts["registrant"].select(F.col("id").alias("registrant_id")), "registrant_id"))
    counted = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
               for name, df in [*parts.items(), ("filing_linked", linked)]]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


@query("m09_upsert_campaign_committees", """SELECT fec_committee_id, upper(name) AS name, member_bioguide_id FROM campaign_committees""")
def _(t):
    target = t.campaign_committees.filter("fec_committee_id < 'C5'").withColumn("name", F.lit("x"))
    staged = t.campaign_committees.withColumn("name", F.upper("name"))
    return merge.upsert(target, staged, ["fec_committee_id"], ["name"], ["name"])


@query("m10_load_contributions", f"""SELECT fec_transaction_id, min(cents) AS cents, min(c.fec_committee_id) AS committee_id
    FROM contributions c GROUP BY 1""")
def _(t):
    committees = t.campaign_committees.select("fec_committee_id", F.col("fec_committee_id").alias("committee_id"))
    target = t.contributions.filter("cents < 0").withColumn("committee_id", F.lit("")).drop("fec_committee_id")
    nameless = t.contributions.withColumn("fec_transaction_id", F.when(F.col("cents") % 2 == 0, F.lit("")))
    out = merge.load_contributions(target, t.contributions.unionByName(nameless), committees, ["cents"])
    return flat(out, "fec_transaction_id", "cents", "committee_id")


@query("m11_upsert_media", "SELECT source_type, source_id, title || '+' AS title FROM media")
def _(t):
    staged = t.media.withColumn("title", F.concat("title", F.lit("+")))
    return merge.upsert(t.media.filter("media_id % 2 = 0"), staged, ["source_type", "source_id"], ["media_id"]).select(
        "source_type", "source_id", "title")


@query("m12_upsert_sentiment", f"SELECT media_id, model_name, {R('-sentiment_score')} AS sentiment_score FROM sentiment")
def _(t):
    staged = t.sentiment.withColumn("sentiment_score", -F.col("sentiment_score"))
    return flat(merge.upsert(t.sentiment, staged, ["media_id", "model_name"], ["sentiment_label"]),
                "media_id", "model_name", "sentiment_score")


def _loaded(t: Tables, name: str, batches: list, keys: list[str], step):
    """The batches applied to a bucketed table one after the other, the last one twice, as after a failure."""
    table = KeyedTable(t.spark, new_folder(t.spark, name), batches[0].schema, keys)
    for i, rows in enumerate([*batches, batches[-1]]):
        table.apply(rows, step, min(i, len(batches) - 1))
    return table.read()


@query("m01_sink_trades", f"""SELECT trade_id + late AS trade_id, member_name, ticker, {S('transaction_date')} AS transaction_date, transaction_type,
      {R('amount_range_low')} AS amount_range_low
    FROM (SELECT *, ticker IS NULL OR amount_range_low IS NULL AS keyless, row_number() OVER (PARTITION BY member_name, ticker,
      transaction_date, transaction_type, amount_range_low ORDER BY trade_id) AS rn FROM trades) CROSS JOIN (VALUES (0), (1000000000)) l(late)
    WHERE keyless OR (rn = 1 AND late = 0)""")
def _(t):
    columns = ["trade_id", *TRADE_KEYS]
    old = t.trades.filter("year(transaction_date) < 1998").select(*columns)
    late = t.trades.withColumn("trade_id", F.col("trade_id") + 1000000000)
    fresh = t.trades.filter("year(transaction_date) >= 1998").unionByName(late).select(*columns)
    rows = _loaded(t, "trades", [old, fresh], TRADE_KEYS, lambda a, b: merge.insert_new(a, b, TRADE_KEYS, ["trade_id"]))
    return flat(rows, *columns)


@query("m02_sink_prices", f"SELECT ticker, {S('date')} AS date, {R('adj_close')} AS adj_close FROM prices")
def _(t):
    slim = t.prices.select("ticker", "date", "adj_close")
    half = F.month("date") <= 6
    rest = slim.withColumn("adj_close", F.when(half, -1.0).otherwise(F.col("adj_close")))
    again = slim.filter(~half).withColumn("adj_close", F.col("adj_close") + 1)
    keys = ["ticker", "date"]
    rows = _loaded(t, "prices", [slim.filter(half), rest.unionByName(again)], keys, lambda a, b: merge.insert_new(a, b, keys, ["adj_close"]))
    return flat(rows, "ticker", "date", "adj_close")


@query("m03_sink_members", """SELECT bioguide_id, full_name, CASE WHEN CAST(bioguide_id AS BIGINT) % 2 = 0 THEN 'New' ELSE party END AS party, state FROM members""")
def _(t):
    slim = t.members.select("bioguide_id", "full_name", "party", "state")
    staged = slim.filter("cast(bioguide_id as long) % 2 = 0").withColumn("party", F.lit("New"))
    return _loaded(t, "members", [slim, staged], ["bioguide_id"], lambda a, b: merge.upsert(a, b, ["bioguide_id"], ["full_name"]))


@query("m11_sink_media", "SELECT media_id, source_type, source_id, title || '+' AS title, content FROM media")
def _(t):
    slim = t.media.select("media_id", "source_type", "source_id", "title", "content")
    staged = slim.withColumn("title", F.concat("title", F.lit("+")))
    keys = ["source_type", "source_id"]
    return _loaded(t, "media", [slim.filter("media_id % 2 = 0"), staged], keys, lambda a, b: merge.upsert(a, b, keys, ["media_id"]))


@query("m12_sink_sentiment", f"SELECT media_id, model_name, sentiment_label, {R('-sentiment_score')} AS sentiment_score FROM sentiment")
def _(t):
    slim = t.sentiment.select("media_id", "model_name", "sentiment_label", "sentiment_score")
    staged = slim.withColumn("sentiment_score", -F.col("sentiment_score"))
    keys = ["media_id", "model_name"]
    # a placement by part of the key holds all rows of the whole key too
    return flat(_loaded(t, "sentiment", [slim, staged], ["media_id"], lambda a, b: merge.upsert(a, b, keys, ["sentiment_label"])))


@query("m13_insert_mentions", """SELECT DISTINCT media_id, unnest(member_bioguide_ids) AS member_bioguide_id FROM media""")
def _(t):
    rows = t.media.select("media_id", F.explode("member_bioguide_ids").alias("member_bioguide_id"))
    return merge.insert_new(rows.filter("media_id % 3 = 0"), rows.unionByName(rows), ["member_bioguide_id", "media_id"], [])


@query("m14_load_assignments", """SELECT DISTINCT member_bioguide_id, committee_code, congress_number FROM assignments""")
def _(t):
    target = t.assignments.filter("congress_number = 117")
    unknown = t.assignments.withColumn("member_bioguide_id", F.concat(F.lit("?"), "member_bioguide_id"))
    return merge.load_assignments(target, t.assignments.unionByName(unknown), t.members).select(
        "member_bioguide_id", "committee_code", "congress_number")


@query("m15_enrich_bills", f"""SELECT bill_id, {S('''CASE WHEN introduced_date IS NULL THEN latest_action_date ELSE introduced_date END''')}
    AS introduced_date, 'Area' AS policy_area, CASE WHEN m.bioguide_id IS NOT NULL AND CAST(m.bioguide_id AS BIGINT) % 2 = 0
      THEN m.bioguide_id ELSE 'old' END AS sponsor_bioguide_id
    FROM bills b LEFT JOIN members m ON m.bioguide_id = b.sponsor_bioguide_id""")
def _(t):
    target = t.bills.withColumn("sponsor_name", F.lit("n")).withColumn("sponsor_bioguide_id", F.lit("old"))
    even = F.col("sponsor_bioguide_id").cast("long") % 2 == 0
    detail = t.bills.select(
        "bill_id", F.when(F.col("introduced_date").isNull(), F.col("latest_action_date")).alias("introduced_date"),
        F.lit("Area").alias("policy_area"),
        F.when(even, F.col("sponsor_bioguide_id")).otherwise("unknown").alias("sponsor_bioguide_id"),
        F.lit(None).cast("string").alias("sponsor_name"))
    return flat(merge.enrich_bills(target, detail, t.members), "bill_id", "introduced_date", "policy_area", "sponsor_bioguide_id")


@query("m16_activate_latest", """SELECT artifact_id, model_name, row_number() OVER (PARTITION BY model_name
    ORDER BY trained_at DESC, artifact_id DESC) = 1 AS is_active FROM artifacts""")
def _(t):
    return merge.activate_latest(t.artifacts).select("artifact_id", "model_name", "is_active")


EXPIRY = "2024-01-20 00:00:00"


@query("m17_expire_signals", f"""SELECT signal_id, is_active AND NOT coalesce(expires_at <= TIMESTAMP '{EXPIRY}', false) AS is_active
    FROM signals""")
def _(t):
    return merge.expire_signals(t.signals, F.lit(EXPIRY).cast("timestamp")).select("signal_id", "is_active")


# ---------------------------------------------------------------- linking

OVERRIDES = [("red widget", "OV1"), ("gear", "OV2"), ("old", "OV3")]
LOOKUP = {
    "lookup": """SELECT replace(lower(asset_name), 'cold', 'ld') AS normalised, min(ticker) AS ticker FROM trades
        WHERE ticker IS NOT NULL AND asset_name <> '' GROUP BY 1""",
}


@query("e01_ticker_lookup", "SELECT normalised, ticker FROM lookup", LOOKUP)
def _(t):
    return resolve.ticker_lookup(t.trades)


def _names(t):
    """Company-like names: raw part names with a type or a corporate word."""
    tail = F.element_at(F.array(F.lit(" Standard Inc."), F.lit(" Corp"), F.lit(", Economy Co")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.raw("part").select(F.concat(F.initcap("p_name"), tail).alias("name")).distinct()


NAMED = {
    **LOOKUP,
    "named": """SELECT DISTINCT base || CASE k WHEN 0 THEN ' standard' WHEN 1 THEN '' ELSE ' economy' END AS normal,
        cap || CASE k WHEN 0 THEN ' Standard Inc.' WHEN 1 THEN ' Corp' ELSE ', Economy Co' END AS name FROM (
        SELECT replace(lower(p_name), 'cold', 'ld') AS base, p_partkey % 3 AS k,
          array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS cap FROM part)""",
}
OVERRIDE_SQL = """CASE WHEN contains(normal || '|' || lower(name), 'red widget') THEN 'OV1'
    WHEN contains(normal || '|' || lower(name), 'gear') THEN 'OV2'
    WHEN contains(normal || '|' || lower(name), 'old') THEN 'OV3' END"""


@query("e02_match_override", f"""SELECT name, {OVERRIDE_SQL} AS ticker, {R('0.99')} AS confidence, 'manual' AS method FROM named
    WHERE {OVERRIDE_SQL} IS NOT NULL""", NAMED)
def _(t):
    return flat(resolve.match_override(_names(t), OVERRIDES))


@query("e03_match_exact", f"""SELECT name, l.ticker, {R('1.0')} AS confidence, 'exact' AS method FROM named
    JOIN lookup l ON l.normalised = normal""", NAMED)
def _(t):
    return flat(resolve.match_exact(_names(t), resolve.ticker_lookup(t.trades)))


# The longest common subsequence by rows: each new row is the running maximum of what the letter of ``a`` adds to the old one.
LCS_SQL = """list_max(list_reduce(
    list_prepend(list_transform(string_split(b, ''), lambda y: 0),
      list_transform(string_split(a, ''), lambda x: list_transform(string_split(b, ''), lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))),
    lambda r, e: list_transform([list_transform(range(1, len(e) + 1), lambda k: greatest(r[k], coalesce(r[k - 1], 0) + e[k]))],
      lambda v: list_transform(range(1, len(v) + 1), lambda j: list_max(v[1:j])))[1]))"""


def _fuzzy_views(names: str) -> dict[str, str]:
    """View ``fuzzy`` (name, ticker, score) over the names (name, normal) of a view; pairs that cannot reach the least score are not compared."""
    words = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
    return {
        "known_text": f"SELECT normalised, ticker, {words.format('normalised')} AS b FROM lookup",
        "asked_text": f"SELECT name, {words.format('normal')} AS a FROM {names} WHERE normal <> ''",
        "text_pair": f"""SELECT a, b FROM (SELECT DISTINCT a FROM asked_text), (SELECT DISTINCT b FROM known_text)
            WHERE 2 * least(length(a), length(b)) >= {K.FUZZY_MIN - 0.005} * (length(a) + length(b))""",
        "text_score": f"SELECT a, b, floor(100 * (2.0 * {LCS_SQL} / (length(a) + length(b))) + 0.5) / 100.0 AS score FROM text_pair",
        "fuzzy": f"""SELECT name, ticker, score FROM asked_text JOIN (
            SELECT a, ticker, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, normalised) AS place
            FROM text_score JOIN known_text USING (b) WHERE score >= {K.FUZZY_MIN}) USING (a) WHERE place = 1""",
    }


FUZZY_SQL = f"SELECT name, ticker, {R('score')} AS confidence, CASE WHEN score >= {K.FUZZY_HIGH} THEN 'fuzzy' ELSE 'fuzzy_low' END AS method FROM fuzzy"


def _cascade_views(names: str) -> dict[str, str]:
    """View ``resolved`` (name, ticker, confidence, method) over the names of a view: override, exact, fuzzy."""
    return {
        "by_hand": f"SELECT name, {OVERRIDE_SQL} AS ticker FROM {names} WHERE {OVERRIDE_SQL} IS NOT NULL",
        "by_name": f"SELECT name, l.ticker FROM {names} JOIN lookup l ON l.normalised = normal WHERE name NOT IN (SELECT name FROM by_hand)",
        "left_over": f"""SELECT name, normal FROM {names} WHERE name NOT IN (SELECT name FROM by_hand)
            AND name NOT IN (SELECT name FROM by_name)""",
        **_fuzzy_views("left_over"),
        "resolved": f"""SELECT name, ticker, {R('0.99')} AS confidence, 'manual' AS method FROM by_hand
            UNION ALL SELECT name, ticker, {R('1.0')}, 'exact' FROM by_name UNION ALL {FUZZY_SQL}""",
    }


@query("e04_match_fuzzy", FUZZY_SQL, NAMED | _fuzzy_views("named"))
def _(t):
    return flat(resolve.match_fuzzy(_names(t), resolve.ticker_lookup(t.trades)))


@query("e05_resolve_names", "SELECT name, ticker, confidence, method FROM resolved", NAMED | _cascade_views("named"))
def _(t):
    return flat(resolve.resolve_names(_names(t), resolve.ticker_lookup(t.trades), OVERRIDES))


@query("e06_resolve_clients", """SELECT n.name, CASE WHEN length(n.name) % 2 = 0 THEN 'KNOWN' ELSE r.ticker END AS matched_ticker,
    r.confidence AS match_confidence, r.method AS match_method, CASE WHEN r.name IS NOT NULL THEN n.normal END AS normalized_name
    FROM named n LEFT JOIN resolved r ON r.name = n.name""", NAMED | {
    "open_client": "SELECT name, normal FROM named WHERE length(name) % 2 = 1"} | _cascade_views("open_client"))
def _(t):
    clients = _names(t).select("name", F.when(F.length("name") % 2 == 0, "KNOWN").alias("matched_ticker"))
    return flat(resolve.resolve_clients(clients, t.trades, OVERRIDES))


@query("e07_resolve_employers", f"""SELECT l_orderkey || '-' || l_linenumber AS fec_transaction_id, name AS contributor_employer,
    CASE WHEN l_linenumber = 1 THEN 'KNOWN' ELSE r.ticker END AS matched_ticker, CASE WHEN l_linenumber > 1 THEN r.confidence END AS match_confidence
    FROM lineitem JOIN employer ON p_partkey = l_partkey LEFT JOIN resolved r USING (name)""", NAMED | {
    "employer": """SELECT p_partkey, replace(lower(p_name), 'cold', 'ld') AS normal,
        array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') || ' Corp' AS name FROM part""",
    "open_employer": """SELECT DISTINCT name, normal FROM employer WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber > 1)""",
    } | _cascade_views("open_employer"))
def _(t):
    parts = t.raw("part").select("p_partkey", F.concat(F.initcap("p_name"), F.lit(" Corp")).alias("contributor_employer"))
    c = t.raw("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("fec_transaction_id"),
        "contributor_employer", F.when(F.col("l_linenumber") == 1, "KNOWN").alias("matched_ticker"))
    return flat(resolve.resolve_employers(c, t.trades, OVERRIDES))


EXTRACT = {"ext_src": """SELECT trade_id, ticker, CASE WHEN trade_id % 8 = 0 AND ticker IS NOT NULL THEN 'vanguard fund ' || trade_id % 50
      WHEN trade_id % 8 = 1 AND ticker IS NOT NULL THEN translate(CAST(trade_id % 1000 AS VARCHAR), '0123456789', 'ABCDEFGHIJ')
      WHEN trade_id % 8 = 2 AND ticker IS NOT NULL THEN 'Odd Name (' || translate(CAST(trade_id % 100 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || ')'
      WHEN trade_id % 8 = 3 AND ticker IS NOT NULL THEN 'apple inc' ELSE asset_name END AS asset_name,
      CASE WHEN trade_id % 8 < 5 THEN NULL ELSE ticker END AS known FROM trades"""}


def _untickered(t):
    k = F.col("trade_id")
    letters = lambda c: F.translate(c.cast("string"), "0123456789", "ABCDEFGHIJ")
    has = F.col("ticker").isNotNull()
    name = (
        F.when(has & (k % 8 == 0), F.concat(F.lit("vanguard fund "), (k % 50).cast("string")))
        .when(has & (k % 8 == 1), letters(k % 1000))
        .when(has & (k % 8 == 2), F.concat(F.lit("Odd Name ("), letters(k % 100), F.lit(")")))
        .when(has & (k % 8 == 3), "apple inc").otherwise(F.col("asset_name")))
    return t.trades.withColumn("asset_name", name).withColumn("ticker", F.when(k % 8 >= 5, F.col("ticker")))


EXTRACTED_SQL = """SELECT DISTINCT asset_name, CASE WHEN contains(asset_name, 'fund') THEN NULL WHEN asset_name = 'apple inc' THEN 'AAPL'
      WHEN regexp_matches(asset_name, '^[A-Z]{1,5}$') THEN asset_name
      WHEN contains(asset_name, '(') THEN CASE WHEN length(regexp_extract(asset_name, '\\(([A-Z]+)\\)', 1)) >= 2
        THEN regexp_extract(asset_name, '\\(([A-Z]+)\\)', 1) END
      ELSE l.ticker END AS ticker
    FROM ext_src LEFT JOIN (SELECT asset_name AS n, min(known) AS ticker FROM ext_src WHERE known IS NOT NULL GROUP BY 1) l
      ON l.n = asset_name WHERE known IS NULL AND asset_name IS NOT NULL AND asset_name <> ''"""


@query("e08_extract_tickers", f"SELECT asset_name, ticker FROM ({EXTRACTED_SQL}) WHERE ticker IS NOT NULL", EXTRACT)
def _(t):
    return resolve.extract_tickers(_untickered(t))


@query("e09_apply_tickers", f"""SELECT s.trade_id, CASE WHEN s.known IS NOT NULL OR x.ticker IS NULL THEN 'kept'
      WHEN t.amount_range_low IS NULL THEN 'updated'
      WHEN s.trade_id = first_value(s.trade_id) OVER w AND count(s.known) OVER k = 0 THEN 'updated' ELSE 'conflict' END AS outcome
    FROM ext_src s JOIN trades t ON t.trade_id = s.trade_id LEFT JOIN ({EXTRACTED_SQL}) x ON x.asset_name = s.asset_name AND s.known IS NULL
    WINDOW w AS (PARTITION BY t.member_name, coalesce(s.known, x.ticker), t.transaction_date, t.transaction_type, t.amount_range_low
        ORDER BY s.known IS NOT NULL, s.trade_id), k AS (PARTITION BY t.member_name, coalesce(s.known, x.ticker), t.transaction_date,
        t.transaction_type, t.amount_range_low)""", EXTRACT)
def _(t):
    trades = _untickered(t)
    return resolve.apply_tickers(trades, resolve.extract_tickers(trades)).select("trade_id", F.col("_outcome").alias("outcome"))


LINK = {
    "mlook": """SELECT lower(coalesce(nullif(last_name, ''), string_split(full_name, ' ')[-1])) AS last_key, bioguide_id,
        lower(full_name) AS fullname, lower(first_name) AS firstname FROM members""",
    "mname": """SELECT DISTINCT member_name, lower(split_part(member_name, ',', 1)) AS last_key,
        lower(replace(trim(split_part(member_name, ',', 2)), 'Hon.. ', '')) AS token FROM trades""",
    "mcand": """SELECT n.member_name, n.token, l.*, count(*) OVER (PARTITION BY n.member_name) AS total,
        (l.firstname = n.token OR list_contains(string_split(l.fullname, ' '), n.token)) AS word,
        contains(l.fullname, n.token) AS part FROM mname n JOIN mlook l ON l.last_key = n.last_key""",
    "mmatch": """SELECT member_name, CASE WHEN max(total) = 1 THEN min(bioguide_id)
          WHEN count(*) FILTER (word) = 1 THEN min(bioguide_id) FILTER (word)
          WHEN count(*) FILTER (word) = 0 AND count(*) FILTER (part) = 1 THEN min(bioguide_id) FILTER (part) END AS bioguide_id,
        CASE WHEN max(total) = 1 THEN 'sole' WHEN count(*) FILTER (word) = 1 THEN 'first_name' ELSE 'substring' END AS method
        FROM mcand GROUP BY 1""",
}


@query("e10_member_lookup", "SELECT last_key, bioguide_id, fullname AS \"full\", firstname AS first FROM mlook", LINK)
def _(t):
    return resolve.member_lookup(t.members)


@query("e11_match_members", """SELECT member_name, CASE WHEN member_name = 'Family1, Given1' THEN 'OV' ELSE bioguide_id END AS bioguide_id,
    CASE WHEN member_name = 'Family1, Given1' THEN 'override' ELSE method END AS method FROM mmatch
    WHERE bioguide_id IS NOT NULL OR member_name = 'Family1, Given1'""", LINK)
def _(t):
    return resolve.match_members(t.trades, resolve.member_lookup(t.members), [("Family1, Given1", "OV")])


@query("e12_link_trades", """SELECT t.trade_id, coalesce(t.member_bioguide_id, m.bioguide_id) AS member_bioguide_id
    FROM trades t LEFT JOIN mmatch m ON m.member_name = t.member_name""", LINK)
def _(t):
    return resolve.link_trades(t.trades, t.members, [("nobody", "x")]).select("trade_id", "member_bioguide_id")


@query("j15_link_committees", """SELECT c.fec_committee_id, coalesce(c.member_bioguide_id, min(m.bioguide_id)) AS member_bioguide_id
    FROM campaign_committees c LEFT JOIN members m ON c.member_bioguide_id IS NULL AND contains(lower(c.name), lower(m.last_name))
      AND contains(lower(c.name), lower(m.first_name)) GROUP BY c.fec_committee_id, c.member_bioguide_id""")
def _(t):
    return resolve.link_committees(t.campaign_committees, t.members).select("fec_committee_id", "member_bioguide_id")
