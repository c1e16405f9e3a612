"""Members, bills, committees, hearings, ideology and committee membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import text as X

MEMBER_SCHEMA = (
    "bioguideId string, name string, firstName string, lastName string, partyName string, party string, state string, "
    "stateCode string, district int, currentMember boolean, chamber string, terms array<struct<chamber string>>"
)
BILL_SCHEMA = (
    "congress int, type string, billType string, number int, title string, introducedDate string, "
    "latestAction struct<actionDate string, text string>, "
    "sponsors array<struct<bioguideId string, fullName string, name string>>, policyArea struct<name string>, "
    "subjects struct<legislativeSubjects array<struct<name string>>>, "
    "committees array<struct<systemCode string, name string>>"
)
COMMITTEE_SCHEMA = (
    "systemCode string, name string, chamber string, parent struct<systemCode string>, url string, isCurrent boolean"
)
HEARING_SCHEMA = (
    "title string, dates array<struct<date string>>, date string, chamber string, congress int, "
    "committees array<struct<systemCode string>>, committee struct<systemCode string>, "
    "associatedBills array<struct<congress int, type string, number string>>, url string, "
    "formats array<struct<url string>>, transcriptUrl string"
)
IDEOLOGY_SCHEMA = (
    "bioguide_id string, congress int, chamber string, party_code int, bioname string, state_abbrev string, "
    "nominate_dim1 double, nominate_dim2 double"
)


def _s(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def normalise_members(raw: DataFrame) -> DataFrame:
    """Names from 'Last, First' when not given apart; chamber of the last term."""
    split = (_s("firstName") == "") & _s("name").contains(", ")
    parts = F.split("name", ", ", 2)
    first = F.when(split, F.try_element_at(parts, F.lit(2))).otherwise(_s("firstName"))
    last = F.when(split, parts[0]).otherwise(_s("lastName"))
    full = F.trim(F.concat_ws(" ", first, last))
    has_terms = F.size(F.coalesce("terms", F.array().cast("array<struct<chamber string>>"))) > 0
    chamber = F.when(has_terms, F.try_element_at("terms", F.lit(-1))["chamber"]).otherwise(F.col("chamber"))
    state = F.when(F.length("state") > 2, F.coalesce("stateCode", F.substring("state", 1, 2))).otherwise(F.col("state"))
    return raw.select(
        F.trim("bioguideId").alias("bioguide_id"), F.when(full != "", full).otherwise(_s("name")).alias("full_name"),
        first.alias("first_name"), last.alias("last_name"),
        F.when(F.lower(_s(chamber)).contains("senate"), "senate").otherwise("house").alias("chamber"),
        F.nullif(F.substring(_s(state), 1, 2), F.lit("")).alias("state"),
        F.when(F.col("district") != 0, F.col("district").cast("string")).alias("district"),
        F.coalesce("partyName", "party", F.lit("")).alias("party"),
        F.coalesce("currentMember", F.lit(True)).alias("in_office"),
    ).filter("bioguide_id <> ''")


def normalise_bills(raw: DataFrame) -> DataFrame:
    """bill_id is type, number, dash, congress; the first sponsor counts."""
    kind = F.lower(F.coalesce(F.nullif("type", F.lit("")), _s("billType")))
    sponsor = F.try_element_at("sponsors", F.lit(1))
    action = _s("latestAction.text")
    return raw.withColumn("_kind", kind).filter(
        "coalesce(congress, 0) <> 0 and coalesce(number, 0) <> 0 and _kind <> ''"
    ).select(
        F.concat(F.col("_kind"), F.col("number").cast("string"), F.lit("-"), F.col("congress").cast("string"))
        .alias("bill_id"),
        F.col("congress").alias("congress_number"), F.col("_kind").alias("bill_type"),
        F.col("number").alias("bill_number"), _s("title").alias("title"),
        F.substring(_s("title"), 1, 500).alias("short_title"), X.iso_date("introducedDate").alias("introduced_date"),
        sponsor["bioguideId"].alias("sponsor_bioguide_id"),
        F.coalesce(sponsor["fullName"], sponsor["name"]).alias("sponsor_name"),
        F.nullif(F.substring(action, 1, 100), F.lit("")).alias("status"),
        F.coalesce(F.transform("subjects.legislativeSubjects", lambda s: s["name"]), F.array().cast("array<string>"))
        .alias("subjects"),
        F.coalesce(
            F.transform("committees", lambda c: F.struct(
                _s(c["systemCode"]).alias("code"), _s(c["name"]).alias("name"))),
            F.array().cast("array<struct<code string, name string>>")).alias("committees"),
        F.array().cast("array<string>").alias("actions"),
        X.iso_date("latestAction.actionDate").alias("latest_action_date"), action.alias("latest_action_text"),
        F.col("policyArea.name").alias("policy_area"))


def normalise_committees(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.trim("systemCode").alias("system_code"), F.trim("name").alias("name"),
        X.chamber_of("chamber", "joint").alias("chamber"), F.col("parent.systemCode").alias("parent_code"), "url",
        F.coalesce("isCurrent", F.lit(True)).alias("is_current"),
    ).filter("system_code <> '' and name <> ''")


def normalise_hearings(raw: DataFrame, congress: int | None = None) -> DataFrame:
    """The first listed date and committee count, else the single ones."""
    listed = X.iso_date(F.try_element_at("dates", F.lit(1))["date"])
    code = F.coalesce(
        F.nullif(F.try_element_at("committees", F.lit(1))["systemCode"], F.lit("")), F.col("committee.systemCode"))
    link = F.try_element_at(F.filter("formats", lambda f: _s(f["url"]) != ""), F.lit(1))["url"]
    bills = F.transform("associatedBills", lambda b: F.struct(
        b["congress"].alias("congress"), F.lower(_s(b["type"])).alias("type"), b["number"].alias("number")))
    return raw.select(
        code.alias("committee_code"), F.trim("title").alias("title"),
        F.coalesce(listed, X.iso_date("date")).alias("hearing_date"), X.chamber_of("chamber", None).alias("chamber"),
        F.coalesce(F.nullif("congress", F.lit(0)), F.lit(congress)).cast("int").alias("congress_number"),
        F.coalesce(F.nullif("url", F.lit("")), link).alias("url"), F.col("transcriptUrl").alias("transcript_url"),
        F.coalesce(bills, F.array().cast("array<struct<congress int, type string, number string>>"))
        .alias("related_bills"),
    ).filter("title <> ''")


def normalise_ideology(raw: DataFrame, congress: int | None = None) -> DataFrame:
    """Scores of one congress, or of each member's latest; presidents drop out.

    The latest row is chosen before rows without scores or chamber are dropped.
    """
    rows = raw.withColumn("bioguide_id", F.trim("bioguide_id")).filter("bioguide_id <> ''")
    if congress is not None:
        rows = rows.filter(F.col("congress") == congress)
    else:
        from ..operators.merge import first_per_key

        rows = first_per_key(rows, ["bioguide_id"], ["congress", "chamber", "bioname"], last=True)
    parts = F.split("bioname", ", ", 2)
    name = F.when(
        F.col("bioname").contains(", "),
        F.trim(F.concat_ws(" ", X.title_case(F.try_element_at(parts, F.lit(2))), X.title_case(parts[0])))
    ).otherwise(F.col("bioname"))
    party = F.create_map(*[F.lit(v) for kv in K.PARTY_NAMES_BY_CODE.items() for v in kv])[F.col("party_code")]
    chamber = F.when(F.col("chamber") == "Senate", "senate").when(F.col("chamber") == "House", "house")
    return rows.filter("nominate_dim1 is not null or nominate_dim2 is not null").select(
        "bioguide_id", "nominate_dim1", "nominate_dim2", F.col("congress").alias("congress_number"),
        chamber.alias("chamber"), F.coalesce(party, F.col("party_code").cast("string")).alias("party"),
        F.nullif(F.substring("state_abbrev", 1, 2), F.lit("")).alias("state"), name.alias("full_name"),
    ).filter("chamber is not null")


MEMBER_LIST = "array<struct<_id string, _role string>>"
MEMBERSHIP_SCHEMA = (
    f"_code string, _displayname string, _type string, member {MEMBER_LIST}, "
    f"subcommittee array<struct<_code string, _displayname string, member {MEMBER_LIST}>>"
)


def normalise_memberships(raw: DataFrame, crosswalk: DataFrame, congress: int) -> DataFrame:
    """Committee and subcommittee seats; legislator ids mapped through the crosswalk.

    Four-letter codes are padded with zeros to the long form. Vice chairs are
    named on full committees only.
    """
    code = F.lower(_s("_code"))
    main = raw.select(
        F.when(F.length(code) == 4, F.concat(code, F.lit("00"))).otherwise(code).alias("committee_code"),
        _s("_displayname").alias("committee_name"), F.lit(True).alias("vice"), code.alias("parent"),
        F.explode("member").alias("m"))
    sub = raw.select(code.alias("parent"), _s("_displayname").alias("parent_name"), F.explode("subcommittee").alias("s"))
    sub = sub.filter("coalesce(s._code, '') <> ''").select(
        F.rpad(F.concat("parent", "s._code"), F.greatest(F.length("parent") + F.length("s._code"), F.lit(6)), F.lit("0"))
        .alias("committee_code"),
        F.coalesce(
            F.nullif(F.col("s._displayname"), F.lit("")), F.concat("parent_name", F.lit(" - Subcommittee")))
        .alias("committee_name"),
        F.lit(False).alias("vice"), "parent", F.explode("s.member").alias("m"))
    seats = main.unionByName(sub).filter("parent <> ''").withColumn("govtrack", F.expr("try_cast(m._id as long)"))
    return seats.join(crosswalk.select("govtrack", "bioguide"), "govtrack").select(
        F.col("bioguide").alias("member_bioguide_id"), "committee_code", "committee_name",
        F.when(F.col("vice"), X.fold_listed_role("m._role")).otherwise(X.fold_listed_role("m._role", vice=False))
        .alias("role"),
        F.lit(congress).alias("congress_number"))


def normalise_crosswalk(raw: DataFrame) -> DataFrame:
    """Numeric legislator id to member id; a repeated id takes its last member."""
    return raw.select(
        F.col("id.govtrack").cast("long").alias("govtrack"), F.col("id.bioguide").alias("bioguide")
    ).filter("coalesce(govtrack, 0) <> 0 and coalesce(bioguide, '') <> ''").groupBy("govtrack").agg(
        F.max("bioguide").alias("bioguide"))


CROSSWALK_SCHEMA = "id struct<govtrack long, bioguide string>"


def read_members(spark: SparkSession, path: str) -> DataFrame:
    return normalise_members(spark.read.schema(MEMBER_SCHEMA).json(path, multiLine=True))


def read_bills(spark: SparkSession, path: str) -> DataFrame:
    return normalise_bills(spark.read.schema(BILL_SCHEMA).json(path, multiLine=True))


def read_committees(spark: SparkSession, path: str) -> DataFrame:
    return normalise_committees(spark.read.schema(COMMITTEE_SCHEMA).json(path, multiLine=True))


def read_hearings(spark: SparkSession, path: str, congress: int | None = None) -> DataFrame:
    return normalise_hearings(spark.read.schema(HEARING_SCHEMA).json(path, multiLine=True), congress)


def read_ideology(spark: SparkSession, path: str, congress: int | None = None) -> DataFrame:
    """The CSV export; its header may list more columns in any order."""
    names = [c.strip().split(" ") for c in IDEOLOGY_SCHEMA.split(",")]
    raw = spark.read.csv(path, header=True)
    return normalise_ideology(
        raw.select(*[F.col(n).try_cast("double").cast(t).alias(n) if t == "int" else F.col(n).try_cast(t).alias(n)
                     for n, t in names]), congress)


def read_memberships_xml(spark: SparkSession, path: str, crosswalk: DataFrame, congress: int) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "committee").schema(MEMBERSHIP_SCHEMA).load(path)
    return normalise_memberships(raw, crosswalk, congress)


def read_id_crosswalk(spark: SparkSession, paths: list[str]) -> DataFrame:
    return normalise_crosswalk(spark.read.schema(CROSSWALK_SCHEMA).json(paths, multiLine=True))
