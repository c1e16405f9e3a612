"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and stores, per document, the measurements
and one integer whose bit i says that rule i fails. A policy is a versioned set
of rules; ``apply_policy`` decides by one bitwise AND, and ``ablations`` counts
what each rule of a policy removes, and removes alone, by aggregates over the
stored bits. Texts are never read twice.

Words are maximal runs other than space and \\x09-\\x0D. A null or empty text has
no words: all measurements are 0 and the rule on few words fails. Repeated rows
give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import text as tx

#: Measurements, in the order of the ledger's columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_bang_words",
            "n_marked_words")


class Rule(NamedTuple):
    """A named failure condition over the measurements; its place in RULES is its bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > n_words"),
    Rule("shouting", "n_words >= 20 AND 10 * n_bang_words > n_words"),
    Rule("marked_words", "10 * n_marked_words > n_words"),
    Rule("upper_case", "n_words >= 20 AND 2 * n_upper_words > n_words"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 30 * n_words)"),
    Rule("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines"),
)

#: Versioned policies: the rules whose failure removes a document.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": tuple(r.name for r in RULES),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True


def bits_of(policy: str | tuple[str, ...]) -> int:
    """The mask of a policy, by version or by rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    place = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << place[n] for n in names)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(h: np.ndarray, w: tx.Words) -> np.ndarray:
    """Whether each word lies in a 3-word window that its text holds twice or more."""
    ok = tx.complete(w, 3)
    at, own = np.flatnonzero(ok), w.text_of()[ok]
    key = tx.ngram_hashes(h, 3)[at]
    order = np.lexsort((key, own))
    k, o = key[order], own[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    hit = at[order[same[1:] | same[:-1]]]
    covered = np.zeros(len(h) + 3, bool)
    for i in range(3):
        covered[hit + i] = True
    return covered[: len(h)]


def _duplicate_lines(t: tx.Texts, w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them that equal an earlier line."""
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = tx.words(t, newline)
    filled = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    own, key = lines.text_of(), tx.span_hashes(t.data, lines.starts, lines.ends)
    own, key = own[filled], key[filled]
    order = np.lexsort((key, own))
    k, o = key[order], own[order]
    again = o[1:][(k[1:] == k[:-1]) & (o[1:] == o[:-1])]
    return np.bincount(own, minlength=len(t)), np.bincount(again, minlength=len(t))


def _measure(batch: pa.RecordBatch, t: tx.Texts) -> pa.RecordBatch:
    w = tx.words(t)
    h = tx.span_hashes(t.data, w.starts, w.ends)
    point = (t.data & 0xC0) != 0x80
    space = tx.SEPARATOR[t.data]
    last, before = t.data[w.ends - 1], t.data[np.maximum(w.ends - 2, 0)]
    long = w.ends - w.starts > 2
    bang = (last == ord("!")) & (before == ord("!")) & long
    marked = _SYMBOL[last] & _SYMBOL[before] & long
    counts = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    capital, small = counts(_UPPER[t.data]), counts(_SMALL[t.data])
    upper = (capital[w.ends] - capital[w.starts] >= 2) & (small[w.ends] == small[w.starts])
    n_lines, dup = _duplicate_lines(t, w)
    columns = {
        "n_words": w.counts(), "word_chars": _sums(point & ~space, t.offsets), "n_symbols": _sums(_SYMBOL[t.data], t.offsets),
        "n_dup_lines": dup, "n_repeat_words": _sums(_repeated(h, w), w.first), "n_lines": n_lines,
        "n_upper_words": _sums(upper, w.first), "n_bang_words": _sums(bang, w.first), "n_marked_words": _sums(marked, w.first),
    }
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *(pa.array(columns[m], pa.int64()) for m in MEASURES)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, every measurement, and ``failed``: bit i is set where RULES[i] fails."""
    rows = tx.documents(docs).mapInArrow(tx.per_chunk(_measure), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed.cast("long"))


def apply_policy(rows: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(bits_of(policy))) == 0)


def ablations(rows: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """Per rule of a policy: documents that fail it, and that it alone removes.

    The stored bits are counted by mask first, so that one row per distinct mask
    (at most 2**rules) meets the rules.
    """
    mask = bits_of(policy)
    seen = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("mask")).agg(F.count("*").alias("n"))
    names = [r.name for i, r in enumerate(RULES) if mask >> i & 1]
    parts = [
        F.struct(F.lit(n).alias("rule"), F.lit(bits_of((n,))).cast("long").alias("bit")) for n in names
    ]
    each = seen.withColumn("r", F.explode(F.array(*parts)))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_alone"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of every document, and the verdict of policy web-1."""
    rows = apply_policy(ledger(tx.table(spark, sf_dir, "documents")), "web-1")
    base = F.col("failed").bitwiseAND(F.lit(bits_of("base-1"))) != 0
    return rows.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed")


#: Base measures and verdict from the texts alone; DuckDB.
OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS v(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x: regexp_matches(x, '[A-Z][^a-z]*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS upper,
    len(list_filter(words, lambda x: strlen(x) > 2 AND ends_with(x, '!!'))) AS bang,
    len(list_filter(words, lambda x: strlen(x) > 2 AND regexp_matches(x, '[#*$%&|<>]{2}$'))) AS marked
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN n_words >= 20 AND 10 * bang > n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * marked > n_words THEN 16 ELSE 0 END)
    + (CASE WHEN n_words >= 20 AND 2 * upper > n_words THEN 32 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 30 * n_words) THEN 64 ELSE 0 END)
    + (CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines THEN 128 ELSE 0 END) AS failed
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (failed & 3) <> 0 AS base_failed,
  failed = 0 AS kept, failed::BIGINT AS failed
FROM f
"""
