"""Source normalisers on raw-shaped records built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..sources import legislation, media, network, trades as src
from . import read_api as api
from .registry import R, S, flat, query
from .views import Tables, code_sql, committee_code, family_name, given_name, pick

LABELS = [label for label, _, _ in K.AMOUNT_RANGES]


def raw_trades(t: Tables):
    """One textual filing record per trade, in mixed formats."""
    k, day, disclosed = F.col("trade_id"), F.col("transaction_date"), F.col("disclosure_date")
    show = lambda d: (
        F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "MM/dd/yyyy"))
        .when(k % 4 == 2, F.date_format(d, "MM-dd-yyyy")).otherwise(F.when(k % 3 == 0, "unknown")
                                                                 .otherwise(F.date_format(d, "yyyy-MM-dd"))))
    kind = F.col("transaction_type")
    return t.trades.select(
        k.alias("k"), F.concat(F.lit(" "), "member_name", F.lit(" ")).alias("name"),
        F.when(k % 6 == 0, "").when(k % 6 == 1, "--").when(k % 6 == 2, "N/A")
        .otherwise(F.concat(F.lit(" "), "ticker")).alias("tick"),
        F.coalesce("asset_name", F.lit("")).alias("asset"), F.col("asset_type").alias("asset_kind"),
        F.when(kind == "purchase", "Purchase").when(kind == "sale_full", "Sale (Full)")
        .when(kind == "sale_partial", "Sale (Partial)").when(kind == "sale", " sale").when(k % 5 == 0, "gift")
        .otherwise("Exchange").alias("kind"),
        show(day).alias("d1"), show(disclosed).alias("d2"),
        pick(["Self", "Spouse", "Dependent Child", "Joint"], k % 4).alias("owner"),
        F.when(F.col("amount_range_low").isNotNull(), pick(
            LABELS[:5], F.array_position(F.array(*[F.lit(float(lo)) for _, lo, _ in K.AMOUNT_RANGES[:5]]),
                                         F.col("amount_range_low")) - 1)).alias("label"),
        F.col("amount_range_low").alias("lo"), F.col("amount_range_high").alias("hi"),
        F.col("filing_url").alias("link"), F.col("chamber").alias("house"),
    )


RAW = {
    "rawt": """SELECT trade_id AS k, member_name, CASE WHEN trade_id % 6 <= 2 THEN NULL ELSE ticker END AS ticker,
        coalesce(asset_name, '') AS asset_name, asset_type, filing_url,
        CASE WHEN transaction_type = 'exchange' AND trade_id % 5 = 0 THEN 'gift' ELSE transaction_type END AS kind,
        CASE WHEN trade_id % 4 = 3 AND trade_id % 3 = 0 THEN NULL ELSE transaction_date END AS d1,
        CASE WHEN trade_id % 4 = 3 AND trade_id % 3 = 0 THEN NULL ELSE disclosure_date END AS d2,
        ['member','spouse','dependent','joint'][trade_id % 4 + 1] AS owner,
        amount_range_low AS lo, amount_range_high AS hi FROM trades""",
}
OUT = ["member_name", "filer_type", "ticker", "asset_name", "transaction_type", "transaction_date", "disclosure_date",
       "amount_range_low", "amount_range_high", "filing_url"]


def _trade_sql(owner="owner", url="filing_url", kind="kind", lo="lo", hi="hi", ticker="ticker", where="") -> str:
    return f"""SELECT member_name, {owner} AS filer_type, {ticker} AS ticker, asset_name, {kind} AS transaction_type,
        {S('d1')} AS transaction_date, {S('d2')} AS disclosure_date, {lo} AS amount_range_low, {hi} AS amount_range_high,
        {url} AS filing_url FROM rawt WHERE d1 IS NOT NULL {where}"""


def _house_raw(t):
    r = raw_trades(t)
    return r.select(
        F.lit(2000).alias("disclosure_year"), F.col("d2").alias("disclosure_date"), F.col("d1").alias("transaction_date"),
        "owner", F.col("tick").alias("ticker"), F.col("asset").alias("asset_description"), F.col("kind").alias("type"),
        F.col("label").alias("amount"), F.col("name").alias("representative"), F.lit("").alias("district"),
        F.col("link").alias("ptr_link"), F.lit("yes").alias("cap_gains_over_200_usd"))


@query("s01_house_filings", _trade_sql(owner="CASE owner WHEN 'joint' THEN 'member' ELSE owner END"), RAW)
def _(t):
    return flat(src.normalise_house(_house_raw(t)), *OUT)


def _senate_raw(t):
    return raw_trades(t).select(
        F.col("d1").alias("transaction_date"), F.col("d2").alias("disclosure_date"), "owner",
        F.col("tick").alias("ticker"), F.col("asset").alias("asset_description"), F.col("asset_kind").alias("asset_type"),
        F.col("kind").alias("type"), F.col("label").alias("amount"),
        F.when(F.col("k") % 2 == 0, F.col("name")).otherwise("").alias("senator"), F.col("name").alias("representative"),
        F.col("link").alias("ptr_link"))


@query("s02_senate_filings", _trade_sql(), RAW)
def _(t):
    return flat(src.normalise_senate(_senate_raw(t)), *OUT)


def _csv_raw(t):
    k = F.col("k")
    return raw_trades(t).select(
        k.cast("string").alias("report-id"), F.when(k % 2 == 0, F.col("name")).alias("filer"),
        F.col("name").alias("transactor"), F.col("d2").alias("filed-date"), "owner", F.col("asset").alias("asset-name"),
        F.when(k % 9 == 8, F.repeat(F.lit("X"), 21)).otherwise(F.col("tick")).alias("ticker"),
        F.when(k % 10 == 9, "").otherwise(F.col("kind")).alias("transaction-type"),
        F.when(k % 2 == 0, F.col("d1")).alias("transaction-date"), F.col("d1").alias("date"),
        F.when(k % 2 == 0, F.col("label")).alias("amount"), F.col("label").alias("amount-range"),
        F.col("asset_kind").alias("asset-type"), F.lit("").alias("type"))


@query("s03_senate_csv", _trade_sql(
    url="NULL::VARCHAR", kind="CASE WHEN k % 10 = 9 THEN 'unknown' ELSE kind END",
    ticker="CASE WHEN k % 9 = 8 THEN NULL ELSE ticker END"), RAW)
def _(t):
    return flat(src.normalise_senate_csv(_csv_raw(t)), *OUT)


def _vendor_raw(t):
    k, none = F.col("k"), F.lit(None).cast("string")
    iso = F.when(k % 4 != 2, F.col("d1"))
    return raw_trades(t).select(
        F.when(k % 2 == 0, F.col("tick")).alias("symbol"), F.col("tick").alias("ticker"),
        F.when(k % 2 == 0, iso).alias("transactionDate"), iso.alias("transaction_date"), F.col("d2").alias("disclosureDate"),
        none.alias("disclosure_date"), F.col("kind").alias("type"), none.alias("transactionType"),
        F.when(k % 3 == 0, F.concat(F.lit("$"), F.format_number("lo", 2))).alias("amount"),
        F.col("lo").cast("long").cast("string").alias("amountFrom"),
        F.when(k % 3 != 0, F.col("hi").cast("long").cast("string")).alias("amountTo"), "owner",
        F.when(k % 2 == 0, F.col("name")).alias("representative"), none.alias("senator"),
        F.lit("Ann").alias("firstName"), F.lit("Lee").alias("lastName"), F.col("asset").alias("assetDescription"),
        none.alias("asset_description"), F.col("asset_kind").alias("assetType"), none.alias("asset_type"),
        F.col("link").alias("link"), none.alias("ptrLink"))


@query("s04_vendor_filings", _trade_sql(
    kind="CASE WHEN kind LIKE 'sale%' THEN 'sale' ELSE kind END", hi="CASE WHEN k % 3 = 0 THEN lo ELSE hi END",
    ticker="CASE WHEN k % 6 = 2 THEN 'N/A' ELSE ticker END", where="AND k % 4 <> 2").replace(
    "SELECT member_name", "SELECT CASE WHEN k % 2 = 0 THEN member_name ELSE 'Ann Lee' END AS member_name").replace(
    f"{S('d2')} AS disclosure_date", f"CASE WHEN k % 4 <> 2 THEN {S('d2')} END AS disclosure_date"), RAW)
def _(t):
    return flat(src.normalise_vendor(_vendor_raw(t), "house"), *OUT)


def _index_pages(t):
    k = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("Plain "), k)).otherwise(
        F.concat(F.lit('<a href="/public_disc/'), k, F.lit('.pdf" target="_blank">Filer '), k, F.lit("</a>")))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "FD Original").otherwise("PTR Original")
    last = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.concat(F.lit("<td>"), kind, F.lit("</td>")))
    row = F.concat(F.lit('<tr role="row"><td class="memberName">'), name, F.lit("</td><td>ST"), k, F.lit(
        "</td>\n<td>2024</td>"), last, F.lit("</tr>"))
    return t.raw("orders").groupBy(F.to_date("o_orderdate").alias("page_day")).agg(
        F.concat(F.lit("<html><table>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table></html>")).alias("html"))


@query("s05_filing_index", """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'Plain ' ELSE 'Filer ' END || o_orderkey AS name,
    'ST' || o_orderkey AS office, '2024' AS filing_year, 'PTR Original' AS filing_type,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'https://clerk.example/public_disc/' || o_orderkey || '.pdf' END AS pdf_url
    FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 11 <> 0""")
def _(t):
    return src.parse_filing_index(_index_pages(t), "https://clerk.example/").drop("page_day")


def _letters(c):
    return F.translate((c % 1000).cast("string"), "0123456789", "ABCDEFGHIJ")


def _filing_docs(t):
    k, tick = F.col("trade_id"), _letters(F.col("trade_id"))
    named = F.concat(F.lit("Asset "), k.cast("string"), F.lit(" plc ("), tick, F.lit(") [ST]"))
    us = lambda d: F.date_format(d, "MM/dd/yyyy")
    code = pick(["P", "S", "S (partial)", "E"], k % 4)
    money = F.when(k % 5 == 0, "$50,000,001+").otherwise("$15,001 - $50,000")
    tail = F.concat(code, F.lit(" "), us("transaction_date"), us(F.coalesce("disclosure_date", "transaction_date")), money)
    body = (
        F.when(k % 3 == 0, F.concat(named, F.lit(" "), tail))
        .when(k % 3 == 1, F.concat(F.lit("Filing ID #1\n"), named, F.lit("\n"), tail))
        .otherwise(F.concat(F.lit("\nSP Trust\n"), named, F.lit("\n"), tail)))
    return t.trades.select(
        k.alias("doc_id"), F.col("member_name"), F.concat(F.lit("u"), k.cast("string")).alias("url"),
        F.concat(F.lit("Name: Hon. X\nState/District:AL0"), (k % 7).cast("string"), F.lit("\n\nID Owner Asset\n"), body,
                 F.lit("\nInitial Asset Holdings\n")).alias("text"))


FILED = {"filed": """SELECT trade_id AS doc_id, member_name, 'u' || trade_id AS pdf_url,
    translate(CAST(trade_id % 1000 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS ticker,
    CASE WHEN trade_id % 3 = 2 THEN 'SP Trust ' ELSE '' END || 'Asset ' || trade_id || ' plc' AS asset_name,
    ['P','S','S (partial)','E'][trade_id % 4 + 1] AS transaction_code,
    strftime(transaction_date, '%m/%d/%Y') AS transaction_date_str,
    strftime(coalesce(disclosure_date, transaction_date), '%m/%d/%Y') AS disclosure_date_str,
    CASE WHEN trade_id % 5 = 0 THEN '$50,000,001+' ELSE '$15,001 - $50,000' END AS amount_str,
    CASE WHEN trade_id % 3 = 2 THEN 'Spouse' WHEN trade_id % 1000 = 32 THEN 'Dependent' ELSE 'Self' END AS owner, 'AL0' || (trade_id % 7) AS state_district,
    transaction_date, coalesce(disclosure_date, transaction_date) AS disclosure_date FROM trades"""}


@query("s06_filing_text", """SELECT doc_id, member_name, pdf_url, ticker, asset_name, transaction_code,
    transaction_date_str, disclosure_date_str, amount_str, owner, state_district FROM filed""", FILED)
def _(t):
    return src.parse_filing_text(_filing_docs(t)).drop("line_number")


@query("s07_filing_rows", f"""SELECT member_name, lower(CASE WHEN owner = 'Self' THEN 'member' ELSE owner END) AS filer_type,
    ticker, asset_name, ['purchase','sale','sale_partial','exchange'][doc_id % 4 + 1] AS transaction_type,
    {S('transaction_date')} AS transaction_date, {S('disclosure_date')} AS disclosure_date,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 15001.0::DOUBLE END AS amount_range_low,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 50000.0::DOUBLE END AS amount_range_high, pdf_url AS filing_url FROM filed""",
       FILED)
def _(t):
    return flat(src.normalise_filing_rows(src.parse_filing_text(_filing_docs(t))), *OUT)


def _price_raw(t):
    c, v = F.col("cents"), F.col("volume")
    return t.bars.select(
        "ticker", "date", (c % 10000 / 100.0).alias("open"), (c % 20000 / 100.0).alias("high"),
        F.when(v % 7 != 0, c % 5000 / 100.0).otherwise(0.0).alias("low"), (c % 30000 / 100.0).alias("close"),
        F.when(v % 5 != 0, v).otherwise(0).cast("long").alias("volume"))


@query("s08_prices", f"""SELECT ticker, {S('date')} AS date, {R('nullif(cents % 10000 / 100.0, 0)')} AS open,
    {R('nullif(cents % 20000 / 100.0, 0)')} AS high,
    {R('CASE WHEN volume % 7 <> 0 THEN nullif(cents % 5000 / 100.0, 0) END')} AS low,
    {R('nullif(cents % 30000 / 100.0, 0)')} AS adj_close,
    CAST(CASE WHEN volume % 5 <> 0 THEN volume END AS DOUBLE) AS volume FROM bars""")
def _(t):
    df = src.normalise_prices(_price_raw(t)).withColumn("volume", F.col("volume").cast("double"))
    return flat(df, "ticker", "date", "open", "high", "low", "adj_close", "volume")


def _member_raw(t):
    k, n, none = F.col("c_custkey"), F.col("c_nationkey"), F.lit(None).cast("string")
    term = lambda c: F.struct(F.lit(c).alias("chamber"))
    return t.raw("customer").select(
        F.concat(k.cast("string"), F.lit(" ")).alias("bioguideId"),
        F.concat(family_name(k), F.lit(", "), given_name(k)).alias("name"),
        F.when(k % 2 == 0, given_name(k)).alias("firstName"), F.when(k % 2 == 0, family_name(k)).alias("lastName"),
        F.when(k % 3 == 0, F.col("c_mktsegment")).alias("partyName"), F.col("c_mktsegment").alias("party"),
        F.when(k % 4 == 0, "AL").otherwise("Alabama").alias("state"), F.when(k % 4 == 1, "AX").alias("stateCode"),
        (n % 3).cast("int").alias("district"), F.when(k % 5 != 0, k % 5 == 1).alias("currentMember"),
        F.lit("Senate").alias("chamber"),
        F.when(n % 2 == 0, F.array(term("Senate"), term("House of Representatives")))
        .when(n % 2 == 1, F.array(term("House"), term("Senate"))).alias("terms"))


@query("s09_members", f"""SELECT CAST(c_custkey AS VARCHAR) AS bioguide_id,
    'Given' || (c_custkey % 23) || ' ' || 'Family' || (c_custkey % 311) AS full_name, 'Family' || (c_custkey % 311) AS last_name,
    CASE WHEN c_nationkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber, c_mktsegment AS party,
    CASE c_custkey % 4 WHEN 0 THEN 'AL' WHEN 1 THEN 'AX' ELSE 'Al' END AS state,
    CASE WHEN c_nationkey % 3 <> 0 THEN CAST(c_nationkey % 3 AS VARCHAR) END AS district,
    c_custkey % 5 <= 1 AS in_office FROM customer""")
def _(t):
    return legislation.normalise_members(_member_raw(t)).drop("first_name")


def _bill_raw(t):
    date_text = lambda c: F.concat(F.col(c).cast("string"), F.lit("T00:00:00Z"))
    number = F.regexp_extract("bill_id", r"hr(\d+)-", 1).cast("int")
    person = F.struct(
        F.col("sponsor_bioguide_id").alias("bioguideId"), F.lit(None).cast("string").alias("fullName"),
        F.lit("Rep. X").alias("name"))
    named = lambda c: F.struct(c.alias("name"))
    return t.bills.select(
        F.when(number % 19 != 0, F.col("congress_number")).alias("congress"), F.lit("").alias("type"),
        F.lit("HR").alias("billType"), number.alias("number"), "title", date_text("introduced_date").alias("introducedDate"),
        F.struct(date_text("latest_action_date").alias("actionDate"), F.lit("Referred").alias("text")).alias("latestAction"),
        F.array(person).alias("sponsors"), named(F.col("policy_area")).alias("policyArea"),
        F.struct(F.array(named(F.col("policy_area")), named(F.lit("Other"))).alias("legislativeSubjects")).alias("subjects"),
        F.transform("committees", lambda c: F.struct(c["code"].alias("systemCode"), c["name"].alias("name")))
        .alias("committees"))


@query("s10_bills", f"""SELECT b.bill_id, title, {S('introduced_date')} AS introduced_date,
    {S('latest_action_date')} AS latest_action_date, sponsor_bioguide_id, 'Rep. X' AS sponsor_name, policy_area,
    policy_area || ',Other' AS subjects, codes, 'Referred' AS status FROM bills b JOIN (
      SELECT bill_id, string_agg(code, ',' ORDER BY code) AS codes FROM bill_committees GROUP BY 1) c
    ON b.bill_id = c.bill_id WHERE CAST(regexp_extract(b.bill_id, 'hr(\\d+)-', 1) AS INTEGER) % 19 <> 0""")
def _(t):
    df = legislation.normalise_bills(_bill_raw(t)).withColumn(
        "codes", F.array_join(F.array_sort(F.transform("committees", lambda c: c["code"])), ","))
    return flat(df, "bill_id", "title", "introduced_date", "latest_action_date", "sponsor_bioguide_id", "sponsor_name",
                "policy_area", "subjects", "codes", "status")


@query("s11_committees", f"""SELECT {code_sql('n_nationkey')} AS system_code, n_name AS name,
    ['senate','house','joint'][n_nationkey % 3 + 1] AS chamber,
    CASE WHEN n_nationkey % 2 = 0 THEN 'p' || n_nationkey END AS parent_code, n_nationkey % 4 <> 1 AS is_current FROM nation""")
def _(t):
    n = F.col("n_nationkey")
    raw = t.raw("nation").select(
        committee_code(n).alias("systemCode"), F.concat(F.lit(" "), "n_name").alias("name"),
        pick(["Senate", "House", "Joint"], n % 3).alias("chamber"),
        F.when(n % 2 == 0, F.struct(F.concat(F.lit("p"), n.cast("string")).alias("systemCode"))).alias("parent"),
        F.lit("u").alias("url"), F.when(n % 4 == 0, F.lit(None)).otherwise(n % 4 != 1).alias("isCurrent"))
    return legislation.normalise_committees(raw).drop("url")


def _hearing_raw(t):
    k = F.col("hearing_id")
    d = lambda c: F.struct(c.alias("date"))
    code = F.struct(F.col("committee_code").alias("systemCode"))
    text = F.col("hearing_date").cast("string")
    bill = F.struct(F.lit(118).alias("congress"), F.lit("HR").alias("type"), (k % 100).cast("string").alias("number"))
    return t.hearings.select(
        F.when(k % 13 == 0, "  ").otherwise(F.col("title")).alias("title"),
        F.when(k % 2 == 0, F.array(d(text), d(F.lit("1990-01-01")))).alias("dates"), text.alias("date"),
        pick(["Senate", "House", ""], k % 3).alias("chamber"), F.when(k % 2 == 0, 117).alias("congress"),
        F.when(k % 3 == 0, F.array(code)).alias("committees"), F.when(k % 3 == 1, code).alias("committee"),
        F.when(k % 2 == 1, F.array(bill)).alias("associatedBills"), F.lit("").alias("url"),
        F.array(F.struct(F.lit("").alias("url")), F.struct(F.lit("f").alias("url"))).alias("formats"),
        F.lit(None).cast("string").alias("transcriptUrl"))


HEARD = f"""SELECT CASE WHEN hearing_id % 3 < 2 THEN committee_code END AS committee_code, title,
    {S('hearing_date')} AS hearing_date, CASE hearing_id % 3 WHEN 0 THEN 'senate' WHEN 1 THEN 'house' END AS chamber,
    CASE WHEN hearing_id % 2 = 0 THEN 117 ELSE 118 END AS congress_number, 'f' AS url,
    CASE WHEN hearing_id % 2 = 1 THEN 'hr' || (hearing_id % 100) ELSE '' END AS bills
    FROM hearings WHERE hearing_id % 13 <> 0"""


def _heard(t):
    return legislation.normalise_hearings(_hearing_raw(t), 118).withColumn("bills", F.array_join(
        F.transform("related_bills", lambda b: F.concat(b["type"], b["number"])), ","))


@query("s12_hearings", HEARD)
def _(t):
    return flat(_heard(t), "committee_code", "title", "hearing_date", "chamber", "congress_number", "url", "bills")


@query("s30_valid_hearings", HEARD + " AND hearing_id % 3 < 2")
def _(t):
    return flat(src.valid_hearings(_heard(t)), "committee_code", "title", "hearing_date", "chamber", "congress_number",
                "url", "bills")


def _ideology_raw(t):
    k = F.col("c_custkey")
    score = F.col("c_acctbal") / 10000
    term = lambda c, v: F.struct(F.lit(c).alias("congress"), v.alias("v"))
    return t.raw("customer").select(
        "*", F.explode(F.array(term(117, score), term(118, score / 2))).alias("s")
    ).filter((F.col("s.congress") == 117) | (k % 3 != 0)).select(
        k.cast("string").alias("bioguide_id"), F.col("s.congress").alias("congress"),
        F.when(k % 10 == 0, "President").when(k % 2 == 0, "House").otherwise("Senate").alias("chamber"),
        pick([100, 200, 328, 999], k % 4).alias("party_code"),
        F.concat(F.lit("O'NEIL-"), k.cast("string"), F.lit(", ANN LEE")).alias("bioname"), F.lit("ALX").alias("state_abbrev"),
        F.when(k % 7 != 0, F.col("s.v")).alias("nominate_dim1"), F.when(k % 14 != 0, F.col("s.v")).alias("nominate_dim2"))


def _ideology_sql(where: str, congress: str, value: str) -> str:
    return f"""SELECT CAST(c_custkey AS VARCHAR) AS bioguide_id, {congress} AS congress_number,
        CASE WHEN c_custkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber,
        ['Democratic','Republican','Independent','999'][c_custkey % 4 + 1] AS party, 'AL' AS state,
        'Ann Lee O''Neil-' || c_custkey AS full_name, {R(f'CASE WHEN c_custkey % 7 <> 0 THEN {value} END')} AS nominate_dim1,
        {R(value)} AS nominate_dim2 FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 14 <> 0 {where}"""


@query("s13_ideology_latest", _ideology_sql(
    "", "CASE WHEN c_custkey % 3 <> 0 THEN 118 ELSE 117 END",
    "(c_acctbal / 10000 / CASE WHEN c_custkey % 3 <> 0 THEN 2 ELSE 1 END)"))
def _(t):
    return flat(legislation.normalise_ideology(_ideology_raw(t)))


@query("s13_ideology_one_congress", _ideology_sql("", "117", "(c_acctbal / 10000)"))
def _(t):
    return flat(legislation.normalise_ideology(_ideology_raw(t), 117))


def _crosswalk_raw(t):
    k = F.col("c_custkey")
    return t.raw("customer").select(F.struct(
        F.when(k % 4 != 0, k + 1000).cast("long").alias("govtrack"), k.cast("string").alias("bioguide")).alias("id"))


@query("s15_id_crosswalk", """SELECT c_custkey + 1000 AS govtrack, CAST(c_custkey AS VARCHAR) AS bioguide FROM customer
    WHERE c_custkey % 4 <> 0""")
def _(t):
    return legislation.normalise_crosswalk(_crosswalk_raw(t))


def _membership_raw(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    person = F.struct(
        F.when(k % 9 == 0, "x").otherwise((k + 1000).cast("string")).alias("_id"),
        pick(["Chairman", "Ranking Member", "Vice Chair", "Member"], k % 4).alias("_role"))
    seats = t.raw("customer").groupBy("c_nationkey").agg(F.collect_list(person).alias("member"))
    sub = F.array(
        F.struct(F.lit("7").alias("_code"), F.lit("").alias("_displayname"), F.col("member")),
        F.struct(F.lit("").alias("_code"), F.lit("None").alias("_displayname"), F.col("member")))
    return seats.select(
        F.upper(F.left(committee_code(n), F.lit(4))).alias("_code"), F.concat(F.lit("Committee "), n.cast("string"))
        .alias("_displayname"), F.lit("house").alias("_type"), "member", sub.alias("subcommittee"))


@query("s14_memberships", f"""SELECT CAST(c_custkey AS VARCHAR) AS member_bioguide_id, left({code_sql('c_nationkey')}, 4) || suffix
    AS committee_code, 'Committee ' || c_nationkey || extra AS committee_name,
    CASE c_custkey % 4 WHEN 0 THEN 'chair' WHEN 1 THEN 'ranking' WHEN 2 THEN vice ELSE 'member' END AS role,
    118 AS congress_number FROM customer CROSS JOIN (VALUES ('00', '', 'vice_chair'), ('70', ' - Subcommittee', 'member'))
      v(suffix, extra, vice) WHERE c_custkey % 4 <> 0 AND c_custkey % 9 <> 0""")
def _(t):
    return legislation.normalise_memberships(
        _membership_raw(t), legislation.normalise_crosswalk(_crosswalk_raw(t)), 118)


def _lobbying_raw(t):
    """One nested record per filing: two activities, shared and new lobbyists."""
    f = t.filings.join(t.registrants, F.col("registrant_id") == F.col("senate_id")).join(
        t.clients.select("client_id", F.col("name").alias("client_name")), "client_id")
    y, a = F.col("filing_year"), F.col("amount")
    person = lambda first, last, prefix, covered: F.struct(
        F.struct(first.alias("first_name"), last.alias("last_name"), prefix.alias("prefix")).alias("lobbyist"),
        covered.alias("covered_official_position"))
    ann = person(F.lit("Ann"), F.col("registrant_id"), F.lit("Ms."), F.lit("Chief Counsel, Senate"))
    bob = person(F.lit(""), F.lit("Bob"), F.lit("Mr."), F.lit("Department of Energy"))
    entity = lambda *names: F.array(*[F.struct(F.lit(n).alias("name")) for n in names])
    activity = lambda code, text, ents, people: F.struct(
        F.lit(code).alias("general_issue_code"), text.alias("description"), ents.alias("government_entities"),
        F.array(*people).alias("lobbyists"))
    text = F.concat(F.lit("Work on H.R. "), (y % 100).cast("string"), F.lit(" and S. 5"))
    return f.select(
        "filing_uuid", F.lit("Q1").alias("filing_type"), F.when(y % 2 == 0, "1st Quarter").alias("filing_type_display"),
        F.lit("first_quarter").alias("filing_period"), F.when(y % 3 == 0, F.col("filing_date").cast("string"))
        .alias("filing_date"), F.concat(F.col("filing_date").cast("string"), F.lit("T10:00:00-05:00")).alias("dt_posted"),
        F.when(y % 2 == 0, F.concat(F.lit("$"), F.format_number(a, 2))).alias("income"),
        F.format_number(a, 2).alias("expenses"),
        F.struct(F.col("registrant_id").alias("id"), F.col("name"), F.lit(None).cast("string").alias("description"))
        .alias("registrant"),
        F.struct(F.col("client_name").alias("name"), F.lit("d").alias("general_description"), F.lit("US").alias("country"),
                 F.lit("AL").alias("state")).alias("client"),
        F.array(activity("TAX", text, entity("SENATE", "HOUSE"), [ann, bob]),
                activity("TAX", F.lit(""), entity("HOUSE", ""), [ann])).alias("lobbying_activities"))


def normalised_lobbying(t):
    return network.normalise_lobbying(_lobbying_raw(t), 2001)


@query("s16_lobbying", f"""SELECT filing_uuid, CASE WHEN filing_year % 2 = 0 THEN '1st Quarter' ELSE 'Q1' END AS filing_type,
    {S('filing_date')} AS filing_date, {R('amount')} AS amount, registrant_id, client_id || ' Holdings Inc' AS client_name,
    'TAX' AS codes, 'HOUSE,SENATE' AS entities, 'H.R. ' || (filing_year % 100) || ',S. 5' AS bills,
    'Ann ' || registrant_id || ':true:false,Mr.  Bob:false:true' AS lobbyists FROM filings""")
def _(t):
    df = normalised_lobbying(t)
    people = F.array_join(F.transform("lobbyists", lambda p: F.concat_ws(
        ":", p["name"], p["is_former_congress"].cast("string"), p["is_former_executive"].cast("string"))), ",")
    return flat(df.select(
        "filing_uuid", "filing_type", "filing_date", "amount", F.col("registrant.senate_id").alias("registrant_id"),
        F.col("client.name").alias("client_name"), F.col("general_issue_codes").alias("codes"),
        F.col("government_entities").alias("entities"), F.col("lobbied_bills").alias("bills"), people.alias("lobbyists")))


@query("s17_campaign_committees", """SELECT 'C' || c_custkey AS fec_committee_id,
    CASE WHEN c_custkey % 3 <> 0 THEN 'H' || c_custkey END AS candidate_fec_id FROM customer""")
def _(t):
    none = F.lit(None).cast("string")
    raw = t.campaign_committees.select(
        F.col("fec_committee_id").alias("committee_id"), "name", none.alias("committee_type"), none.alias("party"),
        none.alias("state"), F.when(F.substring("fec_committee_id", 2, 20).cast("long") % 3 != 0, F.array(
            F.concat(F.lit("H"), F.substring("fec_committee_id", 2, 20)), F.lit("Z"))).alias("candidate_ids"))
    return network.normalise_campaign_committees(raw).select("fec_committee_id", "candidate_fec_id")


@query("s18_contributions", f"""SELECT fec_transaction_id, fec_committee_id, contributor_employer,
    {R('cents / 100.0')} AS amount, {S('contribution_date')} AS contribution_date FROM contributions
    WHERE cents % 11 <> 0 AND cents % 13 <> 0""")
def _(t):
    none, c = F.lit(None).cast("string"), F.col("cents")
    raw = t.contributions.select(
        F.col("fec_transaction_id").alias("transaction_id"), F.col("fec_committee_id").alias("committee_id"),
        F.when(c % 11 != 0, "LEE, ANN").otherwise("").alias("contributor_name"), "contributor_employer",
        none.alias("contributor_occupation"), none.alias("contributor_city"), none.alias("contributor_state"),
        none.alias("contributor_zip_code"), F.when(c % 13 != 0, c / 100.0).alias("contribution_receipt_amount"),
        F.concat(F.col("contribution_date").cast("string"), F.lit("T00:00:00")).alias("contribution_receipt_date"),
        none.alias("receipt_type"))
    return flat(network.normalise_contributions(raw), "fec_transaction_id", "fec_committee_id", "contributor_employer",
                "amount", "contribution_date")


# ---------------------------------------------------------------- media


HTML_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
    '&[a-zA-Z]+;', ' ', 'g'), '&#?\w+;', ' ', 'g'), '\s+', ' ', 'g'))"""
PAGE_DATE = "DATE '2000-01-01' + CAST(page_id % 365 AS INTEGER)"


def _page_day():
    return F.date_add(F.lit("2000-01-01").cast("date"), (F.col("page_id") % 365).cast("int"))


MOUT = ["source_type", "source_id", "title", "content", "published_date"]


@query("s19_transcripts", f"""SELECT 'hearing_transcript' AS source_type, 'P' || page_id AS source_id, url AS title,
    {HTML_SQL} AS content, {S(PAGE_DATE)} AS published_date FROM pages""")
def _(t):
    body = F.when(F.col("page_id") % 2 == 0, F.to_json(F.struct(F.col("html").alias("body")))).otherwise(F.col("html"))
    raw = t.raw("pages").select(
        F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("packageId"), F.col("url").alias("title"),
        F.when(F.col("page_id") % 3 == 0, _page_day().cast("string")).alias("dateIssued"), F.lit("c").alias("category"),
        body.alias("_full_text"),
        F.struct(_page_day().cast("string").alias("dateIssued"), F.lit("x").alias("committee"), F.lit("118").alias("congress"),
                 F.lit("d").alias("description")).alias("_summary"))
    return flat(media.normalise_transcripts(raw), *MOUT)


def _doc_stamp():
    d = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("string")
    return F.concat(d, F.lit("T23:30:00Z"))


DOC_DATE = "DATE '2000-01-01' + CAST(doc_id % 365 AS INTEGER)"


@query("s20_news_a", f"""SELECT 'news_a' AS source_type, 'http://n/' || doc_id AS source_id, 'Title ' || doc_id AS title,
    text AS content, {S(DOC_DATE)} AS published_date, source AS author FROM documents WHERE doc_id % 10 <> 0""")
def _(t):
    d = F.col("doc_id")
    raw = t.raw("documents").select(
        F.concat(F.lit("Title "), d.cast("string")).alias("title"), F.when(d % 2 == 0, F.col("text")).otherwise("")
        .alias("description"), F.col("text").alias("content"),
        F.when(d % 10 != 0, F.concat(F.lit("http://n/"), d.cast("string"))).alias("url"), F.lit("i").alias("image"),
        _doc_stamp().alias("publishedAt"), F.struct(F.col("source").alias("name"), F.lit("u").alias("url")).alias("source"))
    return flat(media.normalise_news_a(raw), *MOUT, "author")


@query("s21_news_b", f"""SELECT 'news_b' AS source_type, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'L' END || doc_id AS source_id,
    'Title ' || doc_id AS title, text AS content, {S(DOC_DATE)} AS published_date,
    CASE WHEN doc_id % 3 = 0 THEN source || ', ' || lang ELSE '' END AS author FROM documents""")
def _(t):
    d, none = F.col("doc_id"), F.lit(None).cast("array<string>")
    raw = t.raw("documents").select(
        F.when(d % 2 == 0, F.concat(F.lit("A"), d.cast("string"))).alias("article_id"),
        F.concat(F.lit("Title "), d.cast("string")).alias("title"), F.concat(F.lit("L"), d.cast("string")).alias("link"),
        F.lit(None).cast("string").alias("description"), F.col("text").alias("content"),
        F.replace(F.replace(_doc_stamp(), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")).alias("pubDate"),
        F.col("source").alias("source_id"), F.col("source").alias("source_name"),
        F.when(d % 3 == 0, F.array("source", "lang")).alias("creator"), none.alias("category"), none.alias("keywords"),
        none.alias("country"), F.lit("").alias("image_url"))
    return flat(media.normalise_news_b(raw), *MOUT, "author")


def _feed_raw(t):
    p = F.col("page_id")
    stamp = F.when(p % 2 == 0, F.concat(F.lit("Mon, "), F.date_format(_page_day(), "dd MMM yyyy"), F.lit(" 22:10:00 -0400"))
                   ).otherwise(F.concat(_page_day().cast("string"), F.lit("T05:00:00+02:00")))
    return t.raw("pages").select(
        F.when(p % 3 == 0, F.concat(F.lit("G"), p.cast("string"))).alias("guid"), F.col("url").alias("link"),
        F.when(p % 8 != 0, F.concat(F.lit("Item "), p.cast("string"))).otherwise("").alias("title"),
        F.col("html").alias("description"), F.when(p % 5 != 0, stamp).alias("pubDate"), stamp.alias("updated"),
        F.array(F.lit("a"), F.lit("b")).alias("category"), F.lit("house-floor").alias("feed_name"),
        F.concat(F.lit("feed"), (p % 4).cast("string")).alias("feed_url"))


FEED_SQL = f"""CASE WHEN page_id % 3 = 0 THEN 'G' || page_id ELSE url END AS source_id, 'Item ' || page_id AS title,
    {HTML_SQL} AS content, {S(PAGE_DATE)} AS published_date"""


@query("s22_activity_feed", f"SELECT 'activity_feed' AS source_type, {FEED_SQL}, 'a,b' AS tags FROM pages WHERE page_id % 8 <> 0")
def _(t):
    df = media.normalise_feed(_feed_raw(t)).withColumn("tags", F.col("raw_metadata")["tags"])
    return flat(df, *MOUT, "tags")


@query("s23_press_releases", f"""SELECT 'press_release' AS source_type, {FEED_SQL},
    CASE WHEN page_id % 4 < 3 THEN 'M' || (page_id % 4) ELSE '' END AS member_bioguide_ids FROM pages WHERE page_id % 8 <> 0""")
def _(t):
    raw = _feed_raw(t)
    owners = raw.select("feed_url").distinct().filter("feed_url <> 'feed3'").select(
        "feed_url", F.replace("feed_url", F.lit("feed"), F.lit("M")).alias("bioguide_id"), F.lit("N").alias("member_name"))
    return flat(media.normalise_press_releases(raw, owners), *MOUT, "member_bioguide_ids")


@query("s24_posts", """SELECT 'post' AS source_type, conv_id || '-' || turn AS source_id,
    CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS title, text AS content,
    CAST(DATE '2000-01-01' + CAST(conv_id % 365 AS INTEGER) AS VARCHAR) AS published_date,
    CAST(turn AS VARCHAR) AS likes FROM conversations WHERE text <> ''""")
def _(t):
    raw = t.raw("conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text",
        F.concat(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("conv_id") % 365).cast("int")).cast("string"),
                 F.lit("T01:02:03.000Z")).alias("created_at"),
        F.col("role").alias("screen_name"), F.lit("").alias("bioguide_id"),
        F.struct(F.lit(None).cast("int").alias("retweet_count"), F.col("turn").cast("int").alias("like_count"),
                 F.lit(1).alias("reply_count"), F.lit(2).alias("quote_count")).alias("public_metrics"))
    return flat(media.normalise_posts(raw).withColumn("likes", F.col("raw_metadata")["like_count"]), *MOUT, "likes")


@query("s25_videos", """SELECT 'video' AS source_type, 'v' || conv_id AS source_id, 'Talk ' || conv_id AS title,
    CASE WHEN conv_id % 4 = 3 THEN '' ELSE spoken END AS content,
    CASE WHEN conv_id % 4 <> 3 AND spoken <> '' THEN 'true' ELSE 'false' END AS has_transcript FROM (
    SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS spoken FROM conversations WHERE text IS NOT NULL GROUP BY 1)""")
def _(t):
    c = t.raw("conversations").filter("text is not null")
    raw = c.select("conv_id").distinct().select(
        F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("video_id"),
        F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), F.lit("2000-01-01T00:00:00Z")
        .alias("published"), F.lit("c").alias("channel_id"), F.lit("n").alias("channel_name"))
    spoken = c.filter("conv_id % 4 <> 3").select(
        F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("video_id"), F.col("turn").alias("position"), "text")
    df = media.normalise_videos(raw, spoken).withColumn("has_transcript", F.col("raw_metadata")["has_transcript"])
    return flat(df, "source_type", "source_id", "title", "content", "has_transcript")


# ---------------------------------------------------------------- pooling and splits


@query("s26_split_valid", """SELECT trade_id, CASE WHEN ticker IS NULL THEN 'ticker' ELSE '' END ||
    CASE WHEN ticker IS NULL AND coalesce(disclosure_date < transaction_date, true) THEN ',' ELSE '' END ||
    CASE WHEN coalesce(disclosure_date < transaction_date, true) THEN 'dates' ELSE '' END AS reasons FROM trades""")
def _(t):
    good, bad = src.split_valid(t.trades, {
        "ticker": F.col("ticker").isNotNull(), "dates": F.col("disclosure_date") >= F.col("transaction_date")})
    return good.select("trade_id", F.lit("").alias("reasons")).unionByName(
        bad.select("trade_id", F.array_join("_reasons", ",").alias("reasons")))


@query("s27_first_nonempty", _trade_sql(owner="CASE owner WHEN 'joint' THEN 'member' ELSE owner END"), RAW)
def _(t):
    primary = src.normalise_senate(_senate_raw(t).filter("transaction_date = 'never'"))
    return flat(src.first_nonempty(primary, src.normalise_house(_house_raw(t))), *OUT)


@query("s28_new_filings", """SELECT 'https://filings.example/' || o_orderkey AS pdf_url FROM orders
    WHERE 'https://filings.example/' || o_orderkey NOT IN (SELECT filing_url FROM trades WHERE filing_url IS NOT NULL)""")
def _(t):
    index = t.raw("orders").select(
        F.concat(F.lit("https://filings.example/"), F.col("o_orderkey").cast("string")).alias("pdf_url"))
    return src.new_filings(index, t.trades, "house_clerk")


@query("s29_dedup_by_url", """SELECT filing_url AS url, min(trade_id) AS trade_id FROM trades WHERE filing_url IS NOT NULL GROUP BY 1""")
def _(t):
    return src.dedup_by_url(t.trades.select("trade_id", F.col("filing_url").alias("url")), ["trade_id"])


@query("u01_union_trades", " UNION ALL ".join([
    _trade_sql(owner="CASE owner WHEN 'joint' THEN 'member' ELSE owner END").replace("FROM rawt", ", 'house_watcher' AS source FROM rawt"),
    _trade_sql().replace("FROM rawt", ", 'senate_watcher' AS source FROM rawt")]), RAW)
def _(t):
    both = api.union_all(src.normalise_house(_house_raw(t)), src.normalise_senate(_senate_raw(t)))
    return flat(both, *OUT, "source")


@query("u02_union_media", f"""SELECT 'activity_feed' AS source_type, count(*) AS n FROM pages WHERE page_id % 8 <> 0
    UNION ALL SELECT 'post', count(*) FROM conversations WHERE text <> ''""")
def _(t):
    posts = t.raw("conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text",
        F.lit("").alias("created_at"), F.lit("").alias("screen_name"), F.lit("").alias("bioguide_id"),
        F.struct(*[F.lit(0).alias(c) for c in ("retweet_count", "like_count", "reply_count", "quote_count")])
        .alias("public_metrics"))
    both = api.union_all(media.normalise_feed(_feed_raw(t)), media.normalise_posts(posts))
    return both.groupBy("source_type").agg(F.count("*").alias("n"))
