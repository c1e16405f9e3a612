"""Linking names to tickers and to members."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import text as X

# --- companies -----------------------------------------------------------------


def ticker_lookup(trades: DataFrame) -> DataFrame:
    """(normalised, ticker) pairs seen in trades; the smallest ticker of a name."""
    seen = trades.filter("ticker is not null and asset_name is not null").select("ticker", "asset_name").distinct()
    named = seen.select("ticker", X.normalise_company("asset_name").alias("normalised"))
    return named.filter("normalised <> '' and ticker <> ''").groupBy("normalised").agg(F.min("ticker").alias("ticker"))


def match_override(names: DataFrame, overrides: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Names that contain an override, raw or normalised; the first listed wins."""
    listed = K.NAME_OVERRIDES if overrides is None else overrides
    raw, normal = F.lower(F.trim("name")), X.normalise_company("name")
    ticker = None
    for text, target in listed:
        hit = raw.contains(text) | normal.contains(text)
        ticker = F.when(hit, target) if ticker is None else ticker.when(hit, target)
    return names.withColumn("ticker", ticker).filter("ticker is not null and name <> ''").select(
        "name", "ticker", F.lit(K.OVERRIDE_CONFIDENCE).alias("confidence"), F.lit("manual").alias("method"))


def match_exact(names: DataFrame, lookup: DataFrame) -> DataFrame:
    """Names whose normalised form is a known one."""
    return names.filter("name <> ''").withColumn("normalised", X.normalise_company("name")).join(
        lookup, "normalised").select(
        "name", "ticker", F.lit(K.EXACT_CONFIDENCE).alias("confidence"), F.lit("exact").alias("method"))


def token_sorted(c: Column | str) -> Column:
    """Lower-case words in alphabetical order, joined by single blanks."""
    c = F.col(c) if isinstance(c, str) else c
    cleaned = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))
    return F.array_join(F.array_sort(F.split(cleaned, r"\s+")), " ")


def indel_ratio(a: str, b: str) -> float:
    """2·LCS / (|a|+|b|), the common subsequence counted with bit operations."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        shared = state & masks.get(ch, 0)
        state = ((state + shared) | (state - shared)) & full
    return 2.0 * (len(a) - bin(state).count("1")) / (len(a) + len(b))


#: Letters that one machine word of the vectorised comparison holds, and pairs compared at once.
WORD_LETTERS, PAIRS_AT_ONCE = 63, 2048


def _codes(texts: np.ndarray) -> np.ndarray:
    """Code points of texts, a row each, padded with 0."""
    return np.ascontiguousarray(texts).view(np.uint32).reshape(len(texts), -1)


def common_letters(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, all pairs advancing by one letter of ``b`` a step.

    The letters of ``a``, at most ``WORD_LETTERS``, are the bits of a word; texts hold no NUL.
    """
    known, which = np.unique(np.array(a, dtype=f"<U{max(map(len, a)) or 1}"), return_inverse=True)
    own, other = _codes(known), _codes(np.array(b, dtype=f"<U{max(map(len, b)) or 1}"))
    alphabet = np.unique(own[own > 0])
    masks = np.zeros((len(known), len(alphabet) + 1), np.uint64)  # the last column is of letters that no ``a`` has
    for i in range(own.shape[1]):
        rows = np.flatnonzero(own[:, i])
        masks[rows, np.searchsorted(alphabet, own[rows, i])] |= np.uint64(1 << i)
    place = np.searchsorted(alphabet, other)
    found = place < len(alphabet)
    found[found] = alphabet[place[found]] == other[found]
    place[~found] = len(alphabet)
    size = np.array([len(x) for x in a], np.uint64)
    full = (np.uint64(1) << size) - np.uint64(1)
    state = full.copy()
    for j in range(other.shape[1]):
        shared = state & masks[which, place[:, j]]
        state = ((state + shared) | (state - shared)) & full
    return size.astype(np.int64) - np.bitwise_count(state)


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of each pair, rounded half up to two places; longer texts than a word holds go one by one."""
    left, right = a.tolist(), b.tolist()
    out = np.zeros(len(left))
    short = [i for i, x in enumerate(left) if 0 < len(x) <= WORD_LETTERS]
    for k in range(0, len(short), PAIRS_AT_ONCE):
        part = short[k : k + PAIRS_AT_ONCE]
        xs, ys = [left[i] for i in part], [right[i] for i in part]
        out[part] = 2.0 * common_letters(xs, ys) / np.array([len(x) + len(y) for x, y in zip(xs, ys)])
    for i in sorted(set(range(len(left))) - set(short)):
        out[i] = indel_ratio(left[i], right[i])
    return pd.Series(np.floor(100 * out + 0.5) / 100.0, dtype="float64")


def fuzzy_candidates(left: DataFrame, right: DataFrame, least: float = K.FUZZY_MIN) -> DataFrame:
    """Pairs (a, b) of distinct texts that can reach the least similarity.

    Lossless blocking. At a similarity s the shorter text keeps at least
    s·(|a|+|b|)/2 of its letters in order, so the two share a minimum number of
    bigram occurrences; then they share one among the few rarest of each. Only
    those rarest bigrams (by frequency over both sides) are joined on, with the
    length bound, which keeps common bigrams out of the join.
    """
    floor_s = least - 0.005  # the score is rounded to two places
    grams = lambda t: F.when(
        F.length(t) >= 2, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    ).otherwise(F.array(t))

    def occurrences(df: DataFrame) -> DataFrame:
        numbered = df.select("t", F.posexplode(grams(F.col("t"))).alias("pos", "g"))
        per = numbered.groupBy("t", "g").agg(F.count("*").alias("m"))
        return per.select("t", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("k"), "g").select(
            "t", F.concat_ws("#", "g", F.col("k").cast("string")).alias("g"))

    lo = left.select(F.col("a").alias("t")).distinct()
    ro = right.select(F.col("b").alias("t")).distinct()
    left_g, right_g = occurrences(lo), occurrences(ro)
    freq = left_g.unionByName(right_g).groupBy("g").agg(F.count("*").alias("f"))

    def rarest(occ: DataFrame) -> DataFrame:
        ranked = occ.join(freq, "g").groupBy("t").agg(
            F.array_sort(F.collect_list(F.struct("f", "g"))).alias("gs"))
        n, size = F.length("t"), F.size("gs")
        # letters this text may lose against any partner within the length bound
        lost = F.floor(n - floor_s * (n + F.ceil(n * floor_s / (2 - floor_s))) / 2 + 1e-9)
        shared = F.greatest(size - 2 * lost, F.lit(1))
        keep = F.greatest(size - shared + 1, F.lit(1)).cast("int")
        return ranked.select("t", F.explode(F.slice("gs", F.lit(1), keep)).alias("e")).select("t", F.col("e.g").alias("g"))

    a = rarest(left_g).select(F.col("t").alias("a"), "g")
    b = rarest(right_g).select(F.col("t").alias("b"), "g")
    la, lb = F.length("a"), F.length("b")
    near = 2.0 * F.least(la, lb) >= floor_s * (la + lb)
    return a.join(b, "g").filter(near).select("a", "b").distinct()


def match_fuzzy(names: DataFrame, lookup: DataFrame) -> DataFrame:
    """Best token-sort similarity of each name, from 0.80 on.

    Names and lookup entries are compared as distinct word-sorted texts; ties
    take the alphabetically first known name.
    """
    similarity = F.pandas_udf(_similarity, "double")
    asked = names.filter("name <> ''").select("name", token_sorted(X.normalise_company("name")).alias("a"))
    known = lookup.select("normalised", "ticker", token_sorted("normalised").alias("b"))
    pairs = fuzzy_candidates(asked.filter("a <> ''"), known.filter("b <> ''"))
    scored = pairs.withColumn("score", similarity("a", "b")).filter(F.col("score") >= K.FUZZY_MIN)
    entry = known.groupBy("b").agg(F.min_by("ticker", "normalised").alias("ticker"), F.min("normalised").alias("normalised"))
    best = scored.join(entry, "b").groupBy("a").agg(
        F.min_by(F.struct("ticker", "score"), F.struct((-F.col("score")).alias("s"), "normalised")).alias("v"))
    return asked.join(best, "a").select(
        "name", "v.ticker", F.col("v.score").alias("confidence"),
        F.when(F.col("v.score") >= K.FUZZY_HIGH, "fuzzy").otherwise("fuzzy_low").alias("method"))


def resolve_names(
    names: DataFrame, lookup: DataFrame, overrides: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Cascade over distinct names: override, exact, fuzzy; first hit wins."""
    rest = names.select("name").filter("name is not null and name <> ''").distinct()
    manual = match_override(rest, overrides)
    rest = rest.join(manual, "name", "left_anti")
    exact = match_exact(rest, lookup)
    rest = rest.join(exact, "name", "left_anti")
    return manual.unionByName(exact).unionByName(match_fuzzy(rest, lookup))


def resolve_clients(
    clients: DataFrame, trades: DataFrame, overrides: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Fills matched_ticker, match_confidence, match_method, normalized_name of open clients."""
    open_ = clients.filter("matched_ticker is null")
    found = resolve_names(open_, ticker_lookup(trades), overrides).select(
        "name", F.col("ticker").alias("_t"), F.col("confidence").alias("_c"), F.col("method").alias("_m"))
    joined = clients.join(found, "name", "left")
    fill = F.col("matched_ticker").isNull() & F.col("_t").isNotNull()
    keep = lambda c: F.col(c) if c in clients.columns else F.lit(None)
    return joined.withColumns({
        "match_confidence": F.when(fill, F.col("_c")).otherwise(keep("match_confidence")),
        "match_method": F.when(fill, F.col("_m")).otherwise(keep("match_method")),
        "normalized_name": F.when(fill, X.normalise_company("name")).otherwise(keep("normalized_name")),
        "matched_ticker": F.when(fill, F.col("_t")).otherwise(F.col("matched_ticker")),
    }).drop("_t", "_c", "_m")


def resolve_employers(
    contributions: DataFrame, trades: DataFrame, overrides: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Fills matched_ticker and match_confidence, matching each employer once."""
    employers = contributions.filter("matched_ticker is null").select(
        F.col("contributor_employer").alias("name")).distinct()
    found = resolve_names(employers, ticker_lookup(trades), overrides).select(
        F.col("name").alias("contributor_employer"), F.col("ticker").alias("_t"), F.col("confidence").alias("_c"))
    fill = F.col("matched_ticker").isNull() & F.col("_t").isNotNull()
    old = F.col("match_confidence") if "match_confidence" in contributions.columns else F.lit(None)
    return contributions.join(found, "contributor_employer", "left").withColumns({
        "match_confidence": F.when(fill, F.col("_c")).otherwise(old),
        "matched_ticker": F.when(fill, F.col("_t")).otherwise(F.col("matched_ticker")),
    }).drop("_t", "_c")


# --- tickers in asset names ---------------------------------------------------------


def clean_asset_name(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    text = F.upper(F.trim(F.regexp_replace(c, K.ASSET_SUFFIX_PATTERN, "")))
    return F.trim(F.regexp_replace(text, K.STOCK_TAIL_PATTERN, ""))


def asset_lookup(trades: DataFrame) -> DataFrame:
    """(key, ticker) of cleaned and of raw asset names; the smallest ticker wins."""
    seen = trades.filter("ticker is not null and asset_name is not null").select("asset_name", "ticker").distinct()
    keys = F.explode(F.array_distinct(F.array(clean_asset_name("asset_name"), F.upper(F.trim("asset_name")))))
    return seen.select(keys.alias("key"), "ticker").groupBy("key").agg(F.min("ticker").alias("ticker"))


def extract_tickers(
    trades: DataFrame, manual: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """(asset_name, ticker) for the distinct names of trades without ticker.

    Funds give none; then a listed name, a bare ticker, one in parentheses, and
    the names of other trades, with and without trailing punctuation.
    """
    listed = K.ASSET_NAME_TICKERS if manual is None else manual
    name = F.trim("asset_name")
    fund = F.lit(False)
    for word in K.FUND_WORDS:
        fund = fund | F.lower(name).contains(word)
    table: dict[str, str] = {}
    for text, target in listed:
        table.setdefault(text.upper(), target)
    exact = {text: target for text, target in listed}
    fixed = F.coalesce(
        F.create_map(*[F.lit(v) for kv in exact.items() for v in kv])[name],
        F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[F.upper(name)])
    bare = F.when(name.rlike(K.BARE_TICKER_PATTERN), name)
    paren = F.regexp_extract(name, K.PAREN_TICKER_PATTERN, 1)
    direct = F.coalesce(fixed, bare, F.when(F.length(paren) >= 2, paren))
    cleaned = clean_asset_name(name)
    open_ = trades.filter("ticker is null and asset_name is not null").select("asset_name").distinct()
    df = open_.filter(~fund).select(
        "asset_name", direct.alias("direct"), cleaned.alias("k1"), F.regexp_replace(cleaned, r"[.,; ]+$", "").alias("k2"))
    usable = (F.length("k1") >= 2) & (F.col("k1") != ".")
    known = asset_lookup(trades).filter("ticker <> '' and ticker <> '.'")
    found = (
        df.join(known.select(F.col("key").alias("k1"), F.col("ticker").alias("t1")), "k1", "left")
        .join(known.select(F.col("key").alias("k2"), F.col("ticker").alias("t2")), "k2", "left"))
    return found.select(
        "asset_name", F.coalesce("direct", F.when(usable, F.coalesce("t1", "t2"))).alias("ticker")
    ).filter("ticker is not null")


TRADE_KEY = ["member_name", "ticker", "transaction_date", "transaction_type", "amount_range_low"]


def apply_tickers(trades: DataFrame, matched: DataFrame) -> DataFrame:
    """Trades with extracted tickers; _outcome says updated, conflict or kept.

    Of open rows that would get one and the same unique key the smallest id is
    updated, unless another trade holds the key already. Rows whose key has a
    null never collide.
    """
    found = matched.select("asset_name", F.col("ticker").alias("_new"))
    joined = trades.join(found, "asset_name", "left")
    open_ = joined.filter("ticker is null and _new is not null")
    wanted = open_.select("trade_id", *[F.col("_new").alias("ticker") if k == "ticker" else F.col(k) for k in TRADE_KEY])
    complete = F.lit(True)
    for k in TRADE_KEY:
        complete = complete & F.col(k).isNotNull()
    firsts = wanted.filter(complete).groupBy(*TRADE_KEY).agg(F.min("trade_id").alias("trade_id"))
    free = firsts.join(trades.filter(complete).select(*TRADE_KEY), TRADE_KEY, "left_anti").select("trade_id")
    winners = free.unionByName(wanted.filter(~complete).select("trade_id")).withColumn("_won", F.lit(True))
    out = joined.join(winners, "trade_id", "left")
    won = F.coalesce("_won", F.lit(False))
    outcome = F.when(won, "updated").when(F.col("ticker").isNull() & F.col("_new").isNotNull(), "conflict").otherwise("kept")
    return out.withColumn("_outcome", outcome).withColumn(
        "ticker", F.when(won, F.col("_new")).otherwise(F.col("ticker"))).select(*trades.columns, "_outcome")


# --- members ------------------------------------------------------------------------


def member_lookup(members: DataFrame) -> DataFrame:
    """Members under their last name, else the last word of the full name."""
    given = F.lower(F.trim(F.nullif(F.col("last_name"), F.lit(""))))
    word = F.lower(F.element_at(F.split(F.trim("full_name"), r"\s+"), -1))
    return members.select(
        F.coalesce(given, word).alias("last_key"), "bioguide_id", F.lower("full_name").alias("full"),
        F.lower(F.coalesce("first_name", F.lit(""))).alias("first")).filter("last_key <> ''")


def match_members(
    names: DataFrame, lookup: DataFrame, overrides: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """(member_name, bioguide_id, method) of distinct filing names.

    An override; else the only member of that last name; else the only one whose
    first name or a word of whose name is the first token; else, if no such
    word, the only one whose name contains it. Candidates are counted per last
    name and per (last name, token), never listed.
    """
    listed = K.MEMBER_OVERRIDES if overrides is None else overrides
    fixed = F.create_map(*[F.lit(v) for kv in listed for v in kv])[F.col("member_name")]
    parsed = X.split_member_name("member_name")
    asked = names.select("member_name").filter("member_name is not null").distinct().select(
        "member_name", fixed.alias("_fixed"), F.lower(F.trim(parsed["last"])).alias("last_key"),
        F.lower(F.get(F.split(parsed["first"], r"\s+"), F.lit(0))).alias("token"))
    manual = asked.filter("_fixed is not null").select(
        "member_name", F.col("_fixed").alias("bioguide_id"), F.lit("override").alias("method"))
    open_ = asked.filter("_fixed is null and last_key is not null").drop("_fixed")
    per_last = lookup.groupBy("last_key").agg(F.count("*").alias("n"), F.min("bioguide_id").alias("only"))
    sized = open_.join(per_last, "last_key")
    sole = sized.filter("n = 1").select("member_name", F.col("only").alias("bioguide_id"), F.lit("sole").alias("method"))
    many = sized.filter("n > 1 and token <> ''").drop("n", "only")
    tokens = many.select("last_key", "token").distinct()
    words = lookup.select(
        "last_key", "bioguide_id",
        F.explode(F.array_distinct(F.concat(F.array("first"), F.split("full", r"\s+")))).alias("token"))
    by_word = words.groupBy("last_key", "token").agg(
        F.count("*").alias("n"), F.min("bioguide_id").alias("bioguide_id"))
    hit = many.join(by_word, ["last_key", "token"])
    word = hit.filter("n = 1").select("member_name", "bioguide_id", F.lit("first_name").alias("method"))
    rest = tokens.join(by_word, ["last_key", "token"], "left_anti")
    inside = lookup.join(rest, "last_key").filter(F.col("full").contains(F.col("token"))).groupBy("last_key", "token").agg(
        F.count("*").alias("n"), F.min("bioguide_id").alias("bioguide_id")).filter("n = 1")
    part = many.join(inside, ["last_key", "token"]).select("member_name", "bioguide_id", F.lit("substring").alias("method"))
    return manual.unionByName(sole).unionByName(word).unionByName(part)


def link_trades(
    trades: DataFrame, members: DataFrame, overrides: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Fills member_bioguide_id of unlinked trades from their member name."""
    open_ = trades.filter("member_bioguide_id is null")
    found = match_members(open_, member_lookup(members), overrides).select(
        "member_name", F.col("bioguide_id").alias("_linked"))
    return trades.join(found, "member_name", "left").withColumn(
        "member_bioguide_id", F.coalesce("member_bioguide_id", "_linked")).drop("_linked")


def link_committees(committees: DataFrame, members: DataFrame) -> DataFrame:
    """Campaign committees without member whose name holds a member's names.

    Both names must occur in the committee name; several fitting members give
    the smallest id. Every substring of a committee name as long as some last
    name is looked up, so the join is on equality and still finds names inside
    words. Members of one name count once, by their smallest id, so the join does
    not grow with how many share it.
    """
    m = members.filter("first_name <> '' and last_name <> ''").groupBy(
        F.lower("first_name").alias("first"), F.lower("last_name").alias("last")).agg(F.min("bioguide_id").alias("bioguide_id"))
    lengths = [r[0] for r in m.select(F.length("last").alias("n")).distinct().orderBy("n").collect()]
    open_ = committees.filter("member_bioguide_id is null").select("fec_committee_id", F.lower("name").alias("text"))
    cut = lambda n: F.when(
        F.length("text") >= n,
        F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    pieces = F.array_distinct(F.concat(*[cut(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    found = (
        open_.withColumn("last", F.explode(pieces)).join(m.hint("merge"), "last")  # the members never pass through the driver
        .filter(F.col("text").contains(F.col("first")))
        .groupBy("fec_committee_id").agg(F.min("bioguide_id").alias("_linked")))
    return committees.join(found, "fec_committee_id", "left").withColumn(
        "member_bioguide_id", F.coalesce("member_bioguide_id", "_linked")).drop("_linked")
