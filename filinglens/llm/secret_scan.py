"""Secret scan: three patterns, and character Markov models compared by likelihood.

Everything is DataFrame expressions; no Python runs on the executors.

Patterns (``KINDS``) give the base spans: leftmost, not overlapping within a kind;
matches that fail their length are dropped after matching. The method adds spans
of kind ``markov``: runs of 16 or more key characters with a letter among them
(plain numbers are none), apart from base spans, whose transitions are likelier under a model of random strings than under one of
ordinary identifiers, by ``MIN_RATIO`` in total and ``MIN_MEAN`` a transition (natural logarithms).

The models are transition counts with additive smoothing, trained from labelled
documents. Random strings are the values that the patterns find in at most about
``MAX_LABELLED`` of them, as they are and in capitals and small letters; ordinary
identifiers are the words of 8 or more letters of at most about ``MAX_ORDINARY`` that
are labelled as good, and what programmers make of neighbouring words (``_joins``), so
that the transitions at their seams are ordinary too. Where a table has more, a hash of
doc_id picks them. A quarter of the words, by a hash, trains nothing: the mean ratio
that all but ``FALSE_HITS`` of their identifiers of 16 or more characters stay below is
the least mean of a secret, if it is above ``MIN_MEAN``. Every document is scanned whole.

Positions are code points, ends exclusive. To find them, a match is put between
private-use characters and the text split there; these characters are replaced in
the text beforehand by others that no pattern takes. A null or empty text has no
spans. Repeated rows repeat their results; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import text as tx

# Kind, pattern, group that holds the value, least length of the value. The order is that of the kinds.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
RUN = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z_-]{8,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SMOOTHING = 0.5
MIN_RATIO, MIN_MEAN = 8.0, 1.0
FALSE_HITS = 0.005
MAX_LABELLED, MAX_ORDINARY = 20000, 1000

_OPEN, _VALUE, _CLOSE = "", "", ""
_SPAN = "array<struct<start:int,stop:int,value:string>>"


def _clean(text: Column) -> Column:
    """The text with the three marks replaced, at the same length."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(t.rlike(f"[{_OPEN}-{_CLOSE}]"), F.translate(t, _OPEN + _VALUE + _CLOSE, "???")).otherwise(t)


def _parts(text: Column, pattern: str, group: int) -> Column:
    """The text before the first match, then each match with what follows it; null without a match."""
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$0{_VALUE}${group}{_CLOSE}")
    return F.when(text.rlike(pattern), F.split(marked, _OPEN))


def _spans(parts: Column) -> Column:
    """start, stop and value of each match."""
    def step(acc, part):
        match = F.substring_index(part, _VALUE, 1)
        tail = F.substring_index(part, _VALUE, -1)
        stop = acc["at"] + F.char_length(match)
        one = F.struct(acc["at"].alias("start"), stop.alias("stop"), F.substring_index(tail, _CLOSE, 1).alias("value"))
        rest = F.char_length(F.substring_index(tail, _CLOSE, -1))
        return F.struct((stop + rest).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    begin = F.struct(F.char_length(parts[0]).alias("at"), F.array().cast(_SPAN).alias("out"))
    found = F.aggregate(F.slice(parts, 2, F.size(parts)), begin, step, lambda acc: acc["out"])
    return F.coalesce(found, F.array().cast(_SPAN))


def _at_least(n: int):
    return lambda s: F.char_length(s["value"]) >= n


def base_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in ``keep``, the cleaned text, and one array of spans per kind."""
    rows = docs.select("doc_id", *keep, _clean(F.col("text")).alias("text"))
    rows = rows.select("*", *[_parts(F.col("text"), p, g).alias(f"_{k}") for k, p, g, _ in KINDS])
    return rows.select(
        "doc_id", *keep, "text",
        *[F.filter(_spans(F.col(f"_{k}")), _at_least(n)).alias(k) for k, _, _, n in KINDS])


def _joins(a: Column, b: Column) -> Column:
    """How identifiers are made of two words."""
    low, high = (F.lower(a), F.lower(b)), (F.initcap(a), F.initcap(b))
    return F.array(
        *[F.concat_ws(s, *low) for s in ("_", "-", "/")], F.concat(low[0], high[1]), F.concat(*high), F.upper(F.concat_ws("_", *low)))


def _held(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(4)) == 0


def identifiers(clean: DataFrame) -> DataFrame:
    """Distinct values, their counts n, and held: long words, and neighbouring words joined, if both are held out or neither."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))
    long = clean.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("value"))
    paired = clean.select(words.alias("w")).select(F.explode(F.arrays_zip(
        F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p"))
    paired = paired.select("p.a", "p.b").where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    paired = paired.where(_held(F.col("a")) == _held(F.col("b")))
    joined = paired.select(F.explode(_joins(F.col("a"), F.col("b"))).alias("value"), "n", _held(F.col("a")).alias("held"))
    rows = long.select("value", F.lit(1).cast("long").alias("n"), _held(F.col("value")).alias("held")).unionByName(joined)
    return rows.groupBy("value", "held").agg(F.sum("n").alias("n"))


def _transitions(strings: DataFrame) -> dict[tuple[str, str], int]:
    """Counts of neighbouring characters of the alphabet over the column ``value``, n times each; at most their number squared."""
    size = F.char_length("value")
    at = F.when(size > 1, F.sequence(F.lit(1), size - 1))
    pairs = strings.select(F.explode(F.transform(at, lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair"), "n")
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    known = counted.where(F.col("pair").rlike("^[A-Za-z0-9+/_=.-]{2}$")).collect()
    return {(r["pair"][0], r["pair"][1]): r["n"] for r in known}


def log_ratios(random: dict, ordinary: dict) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary), row by row of the alphabet."""
    size, out = len(ALPHABET), []
    for a in ALPHABET:
        sums = [sum(m.get((a, b), 0) for b in ALPHABET) + SMOOTHING * size for m in (random, ordinary)]
        out += [
            math.log((random.get((a, b), 0) + SMOOTHING) / sums[0]) - math.log((ordinary.get((a, b), 0) + SMOOTHING) / sums[1])
            for b in ALPHABET]
    return out


def _share(rows: DataFrame, most: int, total: int) -> DataFrame:
    """About ``most`` of ``total`` rows, by a hash of doc_id."""
    if total <= most:
        return rows
    place = F.pmod(F.xxhash64(F.concat_ws("-", F.lit("secrets"), F.col("doc_id"))), F.lit(1 << 30))
    return rows.where(place < int(most / total * (1 << 30)))


def train(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_ordinary: int = MAX_ORDINARY,
) -> tuple[list[float], float]:
    """The table of log ratios and the least mean. The labelled ids, of bounded number, are broadcast to the scan of texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().distinct()
    good = known.where("quality = 1").select("doc_id")
    rows = tx.documents(docs)
    labelled = rows.join(F.broadcast(_share(known.select("doc_id").distinct(), max_labelled, known.count())), "doc_id", "left_semi")
    found = base_spans(labelled).select(F.explode(F.concat(*[F.col(k) for k, *_ in KINDS])).alias("s"))
    cased = F.explode(F.array(F.col("s.value"), F.upper("s.value"), F.lower("s.value")))
    random = _transitions(found.select(cased.alias("value"), F.lit(1).alias("n")))
    clean = rows.join(F.broadcast(_share(good, max_ordinary, good.count())), "doc_id", "left_semi")
    names = identifiers(clean)
    table = log_ratios(random, _transitions(names.where("not held")))
    size = F.char_length("value")
    mean = _ratio(F.col("value"), _constant(table)) / (size - 1)
    worst = names.where(F.col("held") & (size >= 16)).agg(F.percentile_approx(mean, F.lit(1 - FALSE_HITS), F.lit(10000)).alias("m")).first()["m"]
    return table, max(MIN_MEAN, worst or 0.0)


def _constant(table: Iterable[float]) -> Column:
    return F.from_json(F.lit(json.dumps(list(table))), "array<double>")


def _ratio(value: Column, table: Column) -> Column:
    """Sum of the log ratios over the transitions of a run."""
    size = len(ALPHABET)
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def total(at):
        return F.aggregate(
            F.sequence(F.lit(1), F.size(at) - 1), F.lit(0.0),
            lambda acc, i: acc + F.get(table, F.get(at, i - 1) * size + F.get(at, i)))

    return F.transform(F.array(codes), total)[0]  # the codes are bound once


def scan(docs: DataFrame, table: Iterable[float], least_mean: float = MIN_MEAN) -> DataFrame:
    """doc_id and one array of spans per kind: the base kinds and ``markov``."""
    ratios = _constant(table)
    rows = base_spans(tx.documents(docs))
    kinds = [k for k, *_ in KINDS]
    rows = rows.select("doc_id", *kinds, _parts(F.col("text"), RUN, 0).alias("_run"))
    rows = rows.select("doc_id", *kinds, F.concat(*kinds).alias("_base"), _spans(F.col("_run")).alias("_runs"))

    def secret(s):
        apart = ~F.exists("_base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
        capitals = s["value"].rlike("^[A-Z/_=+-]+$")  # identifiers are ordinary in capitals too
        ratio = _ratio(F.when(capitals, F.lower(s["value"])).otherwise(s["value"]), ratios)
        return s["value"].rlike("[A-Za-z]") & apart & (ratio >= MIN_RATIO) & (ratio >= least_mean * (F.char_length(s["value"]) - 1))

    return rows.select("doc_id", *kinds, F.filter("_runs", secret).alias("markov"))


def _joined(kinds: Iterable[str]) -> Column:
    """kind:start:end of all spans, by start, then kind as listed."""
    def marked(rank, kind):
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    ordered = F.sort_array(F.concat(*[marked(i, k) for i, k in enumerate(kinds)]))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per base kind and all spans of every document."""
    docs = tx.table(spark, sf_dir, "documents")
    rows = scan(docs, *train(docs, tx.table(spark, sf_dir, "labels")))
    kinds = [k for k, *_ in KINDS]
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(_joined(kinds), 256).alias("base_sha256"),
        _joined([*kinds, "markov"]).alias("spans"))
