"""Trade filings: landed files to the common trade schema.

Each source is a pair: a normaliser from the raw columns to the trade columns,
and a reader that applies it to files with an explicit schema. Rows without a
usable transaction date (and, where the source demands it, member) are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import text as X

TRADE_COLUMNS = [
    "member_name", "filer_type", "ticker", "asset_name", "asset_type", "transaction_type", "transaction_date",
    "disclosure_date", "amount_range_low", "amount_range_high", "chamber", "source", "filing_url",
]
HOUSE_SCHEMA = (
    "disclosure_year int, disclosure_date string, transaction_date string, owner string, ticker string, "
    "asset_description string, type string, amount string, representative string, district string, "
    "ptr_link string, cap_gains_over_200_usd string"
)
SENATE_SCHEMA = (
    "transaction_date string, disclosure_date string, owner string, ticker string, asset_description string, "
    "asset_type string, type string, amount string, senator string, representative string, ptr_link string"
)
SENATE_CSV_SCHEMA = (
    "`report-id` string, filer string, transactor string, `filed-date` string, owner string, `asset-name` string, "
    "ticker string, `transaction-type` string, `transaction-date` string, date string, amount string, "
    "`amount-range` string, `asset-type` string, type string"
)
VENDOR_SCHEMA = (
    "symbol string, ticker string, transactionDate string, transaction_date string, disclosureDate string, "
    "disclosure_date string, type string, transactionType string, amount string, amountFrom string, amountTo string, "
    "owner string, representative string, senator string, firstName string, lastName string, assetDescription string, "
    "asset_description string, assetType string, asset_type string, link string, ptrLink string"
)
US_ORDER = (X.US, X.ISO, X.US_DASH)


def _trim(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _or(*names: str) -> Column:
    """First of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names])


def _finish(df: DataFrame, source: str, chamber: str, **columns: Column) -> DataFrame:
    bounds = columns.pop("bounds")
    all_columns = {
        **columns, "amount_range_low": bounds["low"], "amount_range_high": bounds["high"],
        "chamber": F.lit(chamber), "source": F.lit(source),
    }
    return df.select(*[all_columns[c].alias(c) for c in TRADE_COLUMNS]).filter("transaction_date is not null")


def normalise_house(raw: DataFrame) -> DataFrame:
    """House filings; a joint or missing owner counts as the member."""
    owner = F.lower(_trim("owner"))
    return _finish(
        raw, "house_watcher", "house", member_name=_trim("representative"),
        filer_type=F.when(owner == "joint", "member").otherwise(X.filer_type("owner", keep_joint=False)),
        ticker=X.clean_ticker("ticker"), asset_name=_trim("asset_description"),
        asset_type=F.when(F.col("cap_gains_over_200_usd") != "", "Stock").otherwise(F.col("cap_gains_over_200_usd")),
        transaction_type=X.tx_type("type"), transaction_date=X.parse_date("transaction_date"),
        disclosure_date=X.parse_date("disclosure_date"), bounds=X.amount_bounds("amount"),
        filing_url=F.col("ptr_link"))


def normalise_senate(raw: DataFrame) -> DataFrame:
    """Senate filings; joint owners stay joint."""
    return _finish(
        raw, "senate_watcher", "senate", member_name=F.trim(F.coalesce(_or("senator", "representative"), F.lit(""))),
        filer_type=X.filer_type("owner"), ticker=X.clean_ticker("ticker"), asset_name=_trim("asset_description"),
        asset_type=F.col("asset_type"), transaction_type=X.tx_type("type"),
        transaction_date=X.parse_date("transaction_date"), disclosure_date=X.parse_date("disclosure_date"),
        bounds=X.amount_bounds("amount"), filing_url=F.col("ptr_link"))


def normalise_senate_csv(raw: DataFrame) -> DataFrame:
    """Senate rows of the CSV export: fallback columns, long tickers rejected."""
    formats = (X.ISO, X.US, X.US_DASH, X.US_SHORT)
    return _finish(
        raw, "senate_csv", "senate", member_name=F.trim(_or("filer", "transactor")), filer_type=X.filer_type("owner"),
        ticker=X.clean_ticker("ticker", max_length=20), asset_name=_trim("`asset-name`"),
        asset_type=_or("asset-type"),
        transaction_type=X.tx_type(_or("transaction-type", "type"), buy=("purchase", "buy"), default="unknown"),
        transaction_date=X.parse_date(_or("transaction-date", "date"), formats),
        disclosure_date=X.parse_date("`filed-date`", formats),
        bounds=X.amount_bounds(F.trim(_or("amount", "amount-range"))), filing_url=F.lit(None).cast("string"),
    ).filter("member_name <> ''")


def normalise_vendor(raw: DataFrame, chamber: str, source: str = "vendor") -> DataFrame:
    """Vendor records with alias fields.

    One amount without an upper bound serves as both bounds.
    """
    full = F.trim(F.concat_ws(" ", F.coalesce("firstName", F.lit("")), F.coalesce("lastName", F.lit(""))))
    bounds = {
        "low": X.parse_money(_or("amount", "amountFrom")), "high": X.parse_money(_or("amountTo", "amount")),
    }
    return _finish(
        raw, source, chamber, member_name=F.trim(F.coalesce(_or("representative", "senator"), full)),
        filer_type=X.filer_type("owner"), ticker=X.clean_ticker(_or("symbol", "ticker"), missing=("--",)),
        asset_name=F.trim(F.coalesce("assetDescription", "asset_description", F.lit(""))),
        asset_type=F.coalesce("assetType", "asset_type"),
        transaction_type=X.tx_type(
            _or("type", "transactionType"), buy=("purchase", "buy"), sell=("sale", "sell"), split_sales=False),
        transaction_date=X.parse_date(_or("transactionDate", "transaction_date"), (X.ISO, X.US)),
        disclosure_date=X.parse_date(_or("disclosureDate", "disclosure_date"), (X.ISO, X.US)),
        bounds=bounds, filing_url=_or("link", "ptrLink"),
    ).filter("member_name <> ''")


def read_house_json(spark: SparkSession, path: str) -> DataFrame:
    return normalise_house(spark.read.schema(HOUSE_SCHEMA).json(path, multiLine=True))


def read_senate_json(spark: SparkSession, path: str) -> DataFrame:
    return normalise_senate(spark.read.schema(SENATE_SCHEMA).json(path, multiLine=True))


def read_senate_csv(spark: SparkSession, path: str) -> DataFrame:
    """The header names the columns; those a file lacks are null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    wanted = [c.strip().split(" ")[0].strip("`") for c in SENATE_CSV_SCHEMA.split(", ")]
    return normalise_senate_csv(raw.select(*[
        (F.col(f"`{c}`") if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in wanted]))


def read_vendor_json(spark: SparkSession, path: str, chamber: str) -> DataFrame:
    return normalise_vendor(spark.read.schema(VENDOR_SCHEMA).json(path, multiLine=True), chamber)


# --- filings as documents -----------------------------------------------------------


def parse_filing_index(pages: DataFrame, base_url: str, only: str | None = "PTR") -> DataFrame:
    """Rows of filing-index tables: name, office, filing_year, filing_type, pdf_url.

    Rows need four cells; the link may sit in any cell, in practice the first.
    """
    rows = pages.select(
        *[c for c in pages.columns if c != "html"],
        F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    text = lambda i: F.trim(F.regexp_replace(F.get("cells", F.lit(i)), r"<[^>]+>", ""))
    href = F.regexp_extract(F.get("cells", F.lit(0)), r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)", 1)
    out = rows.withColumn("cells", cells).filter(F.size("cells") >= 4).select(
        *[c for c in rows.columns if c != "row"], text(0).alias("name"), text(1).alias("office"),
        text(2).alias("filing_year"), text(3).alias("filing_type"),
        F.when(href != "", F.concat(F.lit(base_url), F.regexp_replace(href, "^/+", ""))).otherwise("").alias("pdf_url"))
    return out.filter(F.col("filing_type").contains(only)) if only else out


def parse_filing_text(docs: DataFrame) -> DataFrame:
    """Transaction rows in the extracted text of filings.

    A line with code, two dates and an amount is a transaction. Its asset is
    the text before the code, else up to three lines above, nearest a blank or
    heading line; the owner code is looked up in the same four lines. Lines are
    looked at inside their document's array, so a document is never shuffled.
    """
    lines = F.split("text", "\n")
    base = docs.select(
        "doc_id", "member_name", "url", lines.alias("lines"),
        F.regexp_extract("text", K.FILING_STATE_PATTERN, 1).alias("state_district"))
    rows = base.select(
        "doc_id", "member_name", "url", "state_district", "lines", F.posexplode("lines").alias("i", "raw"),
    ).withColumn("line", F.trim("raw")).filter(F.col("line").rlike(K.FILING_ROW_PATTERN))
    part = lambda n: F.regexp_extract("line", K.FILING_ROW_PATTERN, n)
    above = lambda k: F.when(F.col("i") >= k, F.trim(F.get("lines", F.col("i") - k)))
    stops = lambda c: c.isNull() | (c == "") | c.startswith("ID") | c.startswith("Filing")
    a1, a2, a3 = above(1), above(2), above(3)
    collected = (
        F.when(stops(a1), "").when(stops(a2), a1).when(stops(a3), F.concat_ws(" ", a2, a1))
        .otherwise(F.concat_ws(" ", a3, a2, a1)))
    before = F.trim(F.left("line", F.regexp_instr("line", F.lit(K.FILING_ROW_PATTERN)) - 1))
    asset = F.when(before != "", before).otherwise(collected)
    block = F.array_join(F.slice("lines", F.greatest(F.col("i") - 2, F.lit(1)), F.least(F.col("i") + 1, F.lit(4))), " ")
    name = F.regexp_replace(F.regexp_replace(asset, r"\s*\([A-Z]{1,5}\)\s*", " "), K.ASSET_CLASS_TAG_PATTERN, "")
    return rows.select(
        "doc_id", F.col("i").alias("line_number"), "member_name",
        F.nullif(F.regexp_extract(asset, K.FILING_TICKER_PATTERN, 1), F.lit("")).alias("ticker"),
        F.trim(name).alias("asset_name"), F.trim(part(1)).alias("transaction_code"),
        part(2).alias("transaction_date_str"), part(3).alias("disclosure_date_str"), F.trim(part(4)).alias("amount_str"),
        F.when(block.rlike(r"\bSP\b"), "Spouse").when(block.rlike(r"\bDC\b"), "Dependent")
        .when(block.rlike(r"\bJT\b"), "Joint").otherwise("Self").alias("owner"),
        "state_district", F.col("url").alias("pdf_url"))


def normalise_filing_rows(df: DataFrame) -> DataFrame:
    """Parsed filing rows to trades."""
    tx = F.upper(_trim("transaction_code"))
    lower = F.lower("transaction_code")
    kind = (
        F.when(tx == "P", "purchase")
        .when(tx.startswith("S"), F.when(lower.contains("partial"), "sale_partial")
              .when(lower.contains("full"), "sale_full").otherwise("sale"))
        .when(tx == "E", "exchange").otherwise("unknown"))
    ticker = X.clean_ticker("ticker")
    return _finish(
        df, "house_clerk", "house",
        member_name=F.regexp_replace(_trim("member_name"), r"^Hon\.\.?\s*", ""), filer_type=X.filer_type("owner"),
        ticker=ticker, asset_name=X.scrub(_trim("asset_name")), asset_type=F.when(ticker.isNotNull(), "Stock"),
        transaction_type=kind, transaction_date=X.parse_date("transaction_date_str", US_ORDER),
        disclosure_date=X.parse_date("disclosure_date_str", US_ORDER), bounds=X.amount_bounds(_trim("amount_str")),
        filing_url=F.col("pdf_url"),
    ).filter("member_name <> ''")


# --- prices, pooling, incremental loads ----------------------------------------------


PRICE_SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume long"


def normalise_prices(raw: DataFrame) -> DataFrame:
    """Daily bars at four decimals; zero counts as missing; no separate adjustment."""
    price = lambda c: F.round(F.nullif(F.col(c), F.lit(0.0)), 4).cast("decimal(12,4)")
    return raw.select(
        "ticker", "date", *[price(c).alias(c) for c in ("open", "high", "low", "close")],
        price("close").alias("adj_close"), F.nullif(F.col("volume"), F.lit(0).cast("long")).alias("volume"))


def read_prices(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    reader = spark.read.schema(PRICE_SCHEMA)
    return normalise_prices(reader.csv(path, header=True) if format == "csv" else reader.parquet(path))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rejected rows list the rules they break in _reasons."""
    reasons = F.filter(
        F.array(*[F.when(~F.coalesce(cond, F.lit(False)), name) for name, cond in rules.items()]),
        lambda r: r.isNotNull())
    checked = df.withColumn("_reasons", reasons)
    return checked.filter(F.size("_reasons") == 0).drop("_reasons"), checked.filter(F.size("_reasons") > 0)


def first_nonempty(primary: DataFrame, *fallbacks: DataFrame) -> DataFrame:
    """The first source that yields rows."""
    for df in (primary, *fallbacks):
        if not df.isEmpty():
            return df
    return primary


def new_filings(index: DataFrame, trades: DataFrame, source: str) -> DataFrame:
    """Index rows whose document the source's trades do not cite yet."""
    seen = trades.filter((F.col("source") == source) & F.col("filing_url").isNotNull()).select(
        F.col("filing_url").alias("pdf_url"))
    return index.join(seen, "pdf_url", "left_anti")


def dedup_by_url(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per non-empty URL: the first by the order columns."""
    from ..operators.merge import first_per_key

    return first_per_key(df.filter("url is not null and url <> ''"), ["url"], order)


def valid_hearings(hearings: DataFrame) -> DataFrame:
    """Hearings that name a committee."""
    return hearings.filter("committee_code is not null and committee_code <> ''")


