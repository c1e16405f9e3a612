"""Record-level column expressions: parsing, cleaning and folding of raw fields."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from .. import constants as K

ISO, US, US_DASH, US_SHORT = "yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "M/d/yy"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _has(text: Column, words: Iterable[str]) -> Column:
    """True when the text contains one of the words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def blank_to_null(c: Column | str) -> Column:
    trimmed = F.trim(_col(c))
    return F.when(trimmed != "", trimmed)


def tx_type(
    c: Column | str,
    buy: Sequence[str] = ("purchase",),
    sell: Sequence[str] = ("sale",),
    split_sales: bool = True,
    default: str | None = None,
) -> Column:
    """Transaction type folded from free text; unmatched text passes through."""
    text = F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))
    sale = (
        F.when(text.contains("full"), "sale_full")
        .when(text.contains("partial"), "sale_partial")
        .otherwise("sale")
        if split_sales
        else F.lit("sale")
    )
    rest = text if default is None else F.when(text == "", default).otherwise(text)
    return (
        F.when(_has(text, buy), "purchase")
        .when(_has(text, sell), sale)
        .when(text.contains("exchange"), "exchange")
        .otherwise(rest)
    )


def filer_type(c: Column | str, keep_joint: bool = True) -> Column:
    """Who holds the asset, from the owner text."""
    text = F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))
    joint = text.contains("joint") if keep_joint else F.lit(False)
    return (
        F.when(text.contains("spouse"), "spouse")
        .when(_has(text, ("dependent", "child")), "dependent")
        .when(joint, "joint")
        .otherwise("member")
    )


def parse_date(c: Column | str, formats: Sequence[str] = (ISO, US, US_DASH)) -> Column:
    """First format that fits, else null. Two-digit years pivot at 1969."""
    text = F.trim(_col(c))
    tries = []
    for fmt in formats:
        parsed = F.try_to_date(text, fmt)
        if fmt == US_SHORT:
            parsed = F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)
        tries.append(parsed)
    return F.coalesce(*tries)


def iso_date(c: Column | str) -> Column:
    """Date of an ISO date or timestamp string, in the zone it was written in."""
    return F.try_to_date(F.substring(_col(c), 1, 10), ISO)


def rss_date(c: Column | str) -> Column:
    """Date of an RFC-822 or ISO stamp, in the zone it was written in."""
    text = F.trim(_col(c))
    named_day = F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4}) ", 1)
    return F.coalesce(F.try_to_date(named_day, "d MMM yyyy"), iso_date(text))


def parse_money(c: Column | str, money: str = "decimal(15,2)") -> Column:
    """'$1,234.50' to a decimal; blank or malformed is null."""
    digits = F.trim(F.regexp_replace(_col(c).cast("string"), r"[$,]", ""))
    return digits.try_cast(money)


def amount_bounds(c: Column | str) -> Column:
    """Struct (low, high) of a range label; both null for an unknown label."""
    low = F.create_map(*[F.lit(v) for label, lo, _ in K.AMOUNT_RANGES for v in (label, lo)])
    high = F.create_map(*[F.lit(v) for label, _, hi in K.AMOUNT_RANGES for v in (label, hi)])
    return F.struct(
        low[_col(c)].cast("decimal(15,2)").alias("low"),
        high[_col(c)].cast("decimal(15,2)").alias("high"),
    )


def clean_ticker(c: Column | str, missing: Sequence[str] = ("--", "N/A"), max_length: int | None = None) -> Column:
    """Blank and placeholder tickers become null."""
    text = blank_to_null(c)
    bad = text.isin(list(missing))
    if max_length is not None:
        bad = bad | (F.length(text) > max_length)
    return F.when(~bad, text)


def scrub(c: Column | str) -> Column:
    """Remove NUL characters."""
    return F.translate(_col(c), "\u0000", "")


def normalise_company(c: Column | str) -> Column:
    """Lower-case company name without corporate words and punctuation."""
    text = F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))
    text = F.regexp_replace(text, K.CORPORATE_WORDS_PATTERN, " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(c: Column | str) -> Column:
    """Text without tags and entities, blanks collapsed."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"<[^>]+>", " ")
    text = F.regexp_replace(text, r"&[a-zA-Z]+;", " ")
    text = F.regexp_replace(text, r"&#?\w+;", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ticker_mentions(c: Column | str, known: Sequence[str] | Column | None = None) -> Column:
    """Distinct ticker-like words in first-seen order, stop words removed."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(K.MENTION_PATTERN), F.lit(1))
    found = F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in K.MENTION_STOP_WORDS]))
    if known is None:
        return found
    known_col = known if isinstance(known, Column) else F.array(*[F.lit(w) for w in known])
    return F.array_intersect(found, known_col)


def bill_refs(c: Column | str) -> Column:
    """Bill citations in text, as written, in order."""
    return F.transform(
        F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(K.BILL_REFERENCE_PATTERN), F.lit(0)),
        lambda ref: F.trim(ref),
    )


def position_text(c: Column | str) -> Column:
    """A covered position as ``flags_of`` reads it: lower case, empty for null."""
    return F.lower(F.coalesce(_col(c), F.lit("")))


def flags_of(text: Column) -> Column:
    """Struct of revolving-door flags from a ``position_text``, which every word looks into."""
    return F.struct(
        _has(text, K.FORMER_LEGISLATURE_WORDS).alias("is_former_congress"),
        _has(text, K.FORMER_EXECUTIVE_WORDS).alias("is_former_executive"),
    )


def former_flags(c: Column | str) -> Column:
    """Struct of revolving-door flags from a covered-position text."""
    return flags_of(position_text(c))


def lobbyist_name(first: Column, last: Column, prefix: Column) -> Column:
    """'First Last'; the prefix joins in only when one of the two is missing."""
    first, last, prefix = (F.coalesce(c, F.lit("")) for c in (first, last, prefix))
    both = F.trim(F.concat_ws(" ", first, last))
    loose = F.trim(F.concat_ws(" ", prefix, first, last))
    return F.when((first != "") & (last != ""), both).when(loose != "", loose).otherwise("Unknown")


def split_member_name(c: Column | str) -> Column:
    """'Last, Hon.. First Jr.' to struct (last, first); null without a comma."""
    parts = F.split(_col(c), ",", 2)
    first = F.trim(F.regexp_replace(F.trim(F.try_element_at(parts, F.lit(2))), r"Hon\.+\s*", ""))
    first = F.trim(F.regexp_replace(first, K.NAME_SUFFIX_PATTERN, ""))
    return F.when(
        _col(c).contains(","),
        F.struct(
            F.trim(parts[0]).alias("last"),
            F.regexp_replace(first, r"\.+$", "").alias("first"),
        ),
    )


def truncate(c: Column | str, n: int = 2000) -> Column:
    """First n characters; null becomes an empty text."""
    return F.left(F.coalesce(_col(c), F.lit("")), F.lit(n))


def session_number(c: Column | str) -> Column:
    """Number of the two-year legislative session that holds a date."""
    return (F.floor((F.year(_col(c)) - 1789) / 2) + 1).cast("int")


def fold_role(c: Column | str) -> Column:
    """Committee role folded to chair / ranking / member."""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    ranking = text.contains("ranking")
    return (
        F.when(text.contains("chair") & ~ranking, "chair")
        .when(ranking, "ranking")
        .otherwise("member")
    )


def fold_listed_role(c: Column | str, vice: bool = True) -> Column:
    """Committee role folded from the exact titles of a membership list."""
    text = F.lower(F.coalesce(_col(c), F.lit("member")))
    out = F.when(text.isin("chair", "chairman"), "chair").when(text == "ranking member", "ranking")
    if vice:
        out = out.when(text.isin("vice chair", "vice chairman"), "vice_chair")
    return out.otherwise("member")


def title_case(c: Column | str) -> Column:
    """Capital after every non-letter ("O'Neil-Smith"), lower case elsewhere."""
    marked = F.regexp_replace(F.lower(_col(c)), r"([^\p{L}\s])", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def chamber_of(c: Column | str, default: str | None) -> Column:
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    return F.when(text.contains("senate"), "senate").when(text.contains("house"), "house").otherwise(F.lit(default))
