"""Keyed merges of staged rows into a table.

Targets are Parquet-backed DataFrames; a merge returns the new content. Within
a key the choice is made by an aggregate with map-side combine, not a window,
so repeated keys never gather in one task uncombined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _keyed(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by the order columns."""
    pick = F.max_by if last else F.min_by
    # the whole row closes the order, so equal order values still choose one row
    rank = F.struct(*order, F.to_json(F.struct(*df.columns)).alias("_row"))
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(pick(row, rank).alias("_v")).select(
        *[c if c in keys else F.col(f"_v.{c}").alias(c) for c in df.columns])


def first_of_repeated(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``first_per_key`` for keys that seldom repeat.

    The repeated keys are found first and written out by ``keep``, so their size is
    known when the joins are planned: a row whose key is its own is not moved.
    """
    seen = keep(df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys]))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(seen, same, "left_anti").unionByName(first_per_key(df.join(seen, same, "left_semi"), keys, order))


def new_rows(target: DataFrame, staged: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Staged rows that an insert-if-absent would add.

    Keys with a null never collide, so such rows always pass.
    """
    keyed = first_per_key(staged.filter(_keyed(keys)), keys, order)
    fresh = keyed.join(target.filter(_keyed(keys)).select(*keys), list(keys), "left_anti").select(*staged.columns)
    return fresh.unionByName(staged.filter(~_keyed(keys)))


def insert_new(target: DataFrame, staged: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert-if-absent: the target plus the rows whose key it lacks."""
    return target.unionByName(new_rows(target, staged, keys, order), allowMissingColumns=True)


def upsert(
    target: DataFrame, staged: DataFrame, keys: Sequence[str], order: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Update matched keys and add new ones.

    Of repeated staged keys the last by ``order`` wins. Only ``columns`` change
    on a match (default: all staged ones), nulls included; a new row takes every
    staged column. Columns the staged rows lack keep the target's value.
    """
    staged_columns = [c for c in staged.columns if c not in keys and c in target.columns]
    changed = set(columns if columns is not None else staged_columns)
    newest = first_per_key(staged, keys, order, last=True)
    s = newest.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in staged_columns], F.lit(True).alias("_staged"))
    t = target.withColumn("_known", F.lit(True))
    both = t.join(s, list(keys), "full_outer")
    taken = F.col("_staged").isNotNull()
    fresh = F.col("_known").isNull()
    return both.select(*[
        F.col(c) if c in keys or c not in staged_columns
        else F.when(fresh | (taken if c in changed else F.lit(False)), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)
        for c in target.columns
    ])


def split_lobbying(filings: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Nested lobbying filings to registrant, client, filing and lobbyist tables.

    Surrogate keys are hashes of the natural keys. A registrant takes its last
    name, a client and a filing keep their first record, by (date, uuid). All four
    read the filings as ``keep`` writes them out.
    """
    order = ["filing_date", "filing_uuid"]
    rid = F.when(F.col("registrant.senate_id") != "", F.xxhash64("registrant.senate_id"))
    cid = F.when(F.col("client.name") != "", F.xxhash64("client.name"))
    f = keep(filings.withColumn("registrant_id", rid).withColumn("client_id", cid))
    registrants = first_per_key(
        f.filter("registrant_id is not null").select(
            F.col("registrant_id").alias("id"), "registrant.senate_id", "registrant.name", "registrant.description",
            *order),
        ["id"], order, last=True).drop(*order)
    clients = first_per_key(
        f.filter("client_id is not null").select(
            F.col("client_id").alias("id"), "client.name", "client.description", "client.country", "client.state",
            *order),
        ["id"], order).drop(*order)
    one = first_of_repeated(f, ["filing_uuid"], order, keep).withColumn("id", F.xxhash64("filing_uuid"))
    rows = one.select(
        "id", "filing_uuid", "filing_type", "filing_year", "filing_period", "filing_date", "amount", "registrant_id",
        "client_id", F.col("registrant.name").alias("registrant_name"), F.col("client.name").alias("client_name"),
        "specific_issues", "general_issue_codes", "government_entities", "lobbied_bills")
    lobbyists = one.select(F.col("id").alias("filing_id"), F.explode("lobbyists").alias("l")).select(
        F.xxhash64("filing_id", "l.name").alias("id"), "filing_id", "l.*")
    return {"registrant": registrants, "client": clients, "filing": rows, "lobbyist": lobbyists}


def load_contributions(target: DataFrame, staged: DataFrame, committees: DataFrame, order: Sequence[str]) -> DataFrame:
    """Insert contributions with the internal committee key; no id, no row."""
    keyed = staged.filter("fec_transaction_id is not null and fec_transaction_id <> ''")
    mapped = keyed.join(committees.select("fec_committee_id", "committee_id"), "fec_committee_id", "left")
    return insert_new(target, mapped.drop("fec_committee_id"), ["fec_transaction_id"], order)


def load_assignments(target: DataFrame, staged: DataFrame, members: DataFrame) -> DataFrame:
    """Insert absent (member, committee, congress) seats of known members."""
    known = staged.join(
        members.select(F.col("bioguide_id").alias("member_bioguide_id")), "member_bioguide_id", "left_semi")
    keys = ["member_bioguide_id", "committee_code", "congress_number"]
    return insert_new(target, known, keys, ["committee_name", "role"])


def enrich_bills(bills: DataFrame, detail: DataFrame, members: DataFrame) -> DataFrame:
    """Non-null details replace bill columns; an unknown sponsor is ignored."""
    known = members.select(F.col("bioguide_id").alias("_known")).distinct()
    d = detail.join(known, F.col("sponsor_bioguide_id") == F.col("_known"), "left").select(
        "bill_id", F.col("introduced_date").alias("_date"), F.col("policy_area").alias("_area"),
        F.col("_known").alias("_sponsor"), F.col("sponsor_name").alias("_name"))
    return bills.join(d, "bill_id", "left").withColumns({
        "introduced_date": F.coalesce("_date", "introduced_date"),
        "policy_area": F.coalesce("_area", "policy_area"),
        "sponsor_bioguide_id": F.coalesce("_sponsor", "sponsor_bioguide_id"),
        "sponsor_name": F.coalesce("_name", "sponsor_name"),
    }).drop("_date", "_area", "_sponsor", "_name")


def activate_latest(artifacts: DataFrame) -> DataFrame:
    """Exactly the newest artifact of each model is active."""
    newest = artifacts.groupBy("model_name").agg(
        F.max_by("artifact_id", F.struct("trained_at", "artifact_id")).alias("_active"))
    return artifacts.join(newest, "model_name").withColumn(
        "is_active", F.col("artifact_id") == F.col("_active")).drop("_active")


def expire_signals(signals: DataFrame, as_of: Column) -> DataFrame:
    """Signals whose expiry has come are switched off."""
    due = F.coalesce(F.col("expires_at") <= as_of, F.lit(False))
    return signals.withColumn("is_active", F.col("is_active") & ~due)
