"""Lobbying disclosures and campaign finance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X

LOBBYING_SCHEMA = (
    "filing_uuid string, filing_type string, filing_type_display string, filing_period string, filing_date string, "
    "dt_posted string, income string, expenses string, "
    "registrant struct<id string, name string, description string>, "
    "client struct<name string, general_description string, country string, state string>, "
    "lobbying_activities array<struct<general_issue_code string, description string, "
    "government_entities array<struct<name string>>, lobbyists array<struct<"
    "lobbyist struct<first_name string, last_name string, prefix string>, covered_official_position string>>>>"
)
COMMITTEE_SCHEMA = (
    "committee_id string, name string, committee_type string, party string, state string, candidate_ids array<string>"
)
CONTRIBUTION_SCHEMA = (
    "transaction_id string, committee_id string, contributor_name string, contributor_employer string, "
    "contributor_occupation string, contributor_city string, contributor_state string, contributor_zip_code string, "
    "contribution_receipt_amount double, contribution_receipt_date string, receipt_type string"
)


def _s(c):
    return F.coalesce(c, F.lit(""))


def normalise_lobbying(raw: DataFrame, filing_year: int) -> DataFrame:
    """Filings with nested registrant, client and lobbyists; activities flattened.

    Issue codes and entities are sorted sets; a lobbyist named twice keeps the
    first record; the amount is the income, else the expenses.
    """
    acts = F.coalesce("lobbying_activities", F.from_json(F.lit("[]"), raw.schema["lobbying_activities"].dataType))
    issues = F.filter(acts["description"], lambda x: x != "")
    blank = F.array(F.lit(""), F.lit(None).cast("string"))
    distinct = lambda a: F.sort_array(F.array_except(a, blank))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    entities = F.flatten(F.transform(acts, lambda a: F.coalesce(a["government_entities"]["name"], empty("string"))))

    def person(l):
        """The record; a lambda binds the lower-case position, or every word would make it again."""
        return F.transform(F.array(X.position_text(l["covered_official_position"])), lambda text: F.struct(
            X.lobbyist_name(l["lobbyist"]["first_name"], l["lobbyist"]["last_name"], l["lobbyist"]["prefix"]).alias("name"),
            F.nullif(l["covered_official_position"], F.lit("")).alias("covered_position"),
            X.flags_of(text)["is_former_congress"].alias("is_former_congress"),
            X.flags_of(text)["is_former_executive"].alias("is_former_executive")))[0]

    kind = "struct<name string, covered_position string, is_former_congress boolean, is_former_executive boolean>"
    people = F.flatten(F.transform(acts, lambda a: F.coalesce(F.transform(a["lobbyists"], person), empty(kind))))
    names = F.col("_people")["name"]
    first_only = F.filter("_people", lambda p, i: F.array_position(names, p["name"]) == i + 1)
    money = lambda c: F.regexp_replace(c, r"[$,]", "").try_cast("double")
    amount = F.when(_s(F.col("income")) != "", money("income")).when(_s(F.col("expenses")) != "", money("expenses"))
    return (
        raw.filter("filing_uuid <> ''").withColumn("_people", people).withColumn("_issues", issues)
        .select(
            "filing_uuid", F.coalesce("filing_type_display", "filing_type", F.lit("")).alias("filing_type"),
            F.lit(filing_year).alias("filing_year"), "filing_period",
            X.iso_date(F.coalesce(F.nullif("filing_date", F.lit("")), F.col("dt_posted"))).alias("filing_date"),
            amount.alias("amount"),
            F.struct(_s(F.col("registrant.id")).alias("senate_id"), _s(F.col("registrant.name")).alias("name"),
                     F.col("registrant.description").alias("description")).alias("registrant"),
            F.struct(_s(F.col("client.name")).alias("name"), F.col("client.general_description").alias("description"),
                     F.col("client.country").alias("country"), F.col("client.state").alias("state")).alias("client"),
            first_only.alias("lobbyists"), F.col("_issues").alias("specific_issues"),
            distinct(acts["general_issue_code"]).alias("general_issue_codes"),
            distinct(entities).alias("government_entities"),
            F.flatten(F.transform("_issues", X.bill_refs)).alias("lobbied_bills"))
    )


def normalise_campaign_committees(raw: DataFrame) -> DataFrame:
    """Campaign committees with their first candidate id."""
    return raw.filter("committee_id <> ''").select(
        F.col("committee_id").alias("fec_committee_id"), _s(F.col("name")).alias("name"), "committee_type", "party",
        "state", F.try_element_at("candidate_ids", F.lit(1)).alias("candidate_fec_id"))


def normalise_contributions(raw: DataFrame) -> DataFrame:
    """Contributions that name a contributor and an amount."""
    return raw.filter("contributor_name <> '' and contribution_receipt_amount is not null").select(
        F.col("transaction_id").alias("fec_transaction_id"), F.col("committee_id").alias("fec_committee_id"),
        "contributor_name", "contributor_employer", "contributor_occupation", "contributor_city", "contributor_state",
        F.col("contributor_zip_code").alias("contributor_zip"),
        F.col("contribution_receipt_amount").cast("decimal(12,2)").alias("amount"),
        X.iso_date("contribution_receipt_date").alias("contribution_date"),
        F.col("receipt_type").alias("transaction_type"))


def read_lobbying(spark: SparkSession, path: str, filing_year: int) -> DataFrame:
    return normalise_lobbying(spark.read.schema(LOBBYING_SCHEMA).json(path, multiLine=True), filing_year)


def read_campaign_committees(spark: SparkSession, path: str) -> DataFrame:
    return normalise_campaign_committees(spark.read.schema(COMMITTEE_SCHEMA).json(path, multiLine=True))


def read_contributions(spark: SparkSession, path: str) -> DataFrame:
    return normalise_contributions(spark.read.schema(CONTRIBUTION_SCHEMA).json(path, multiLine=True))
