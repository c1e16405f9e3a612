"""Exact substring dedup over words, by seed and extend.

A window is ``length`` consecutive words. Each window is represented by its
winnowed anchor: the smallest hash among the ``seed``-word grams inside it (the
leftmost of equals). Equal windows have equal anchors, so:

1. Seed. Anchors are counted over the corpus; those met once cannot lie in a
   repeat and drop out (``shared.repeated``).
2. Join. Around every shared anchor the match is extended both ways, over all
   windows that the anchor represents, up to ``length - seed`` words to either
   side. The first document of each extended window is found by an aggregate
   with map-side combine, so an anchor held by a third of all documents never
   meets in one task and no pairs are formed.
3. Keep. A document's windows that an earlier document, or an earlier place of
   the same document, also holds are repeats; runs of them are merged into
   maximal spans, and the words they cover are removed.

Windows are judged on the input texts. Words are maximal runs other than space
and \\x09-\\x0D, compared unchanged by 64-bit hashes. A null or empty text, or one
of fewer than ``length`` words, has no window and keeps all its words. Rows that
repeat a doc_id are judged one by one as that document, not against each other.
Rows without a doc_id have no place in the order: they keep all their words and
are no one's first holder, as in the SQL.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import shared
from filinglens.llm import text as tx

LENGTH = 20
SEED = 8


def _smallest(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and place of the leftmost smallest gram among ``width`` from each place on."""
    def better(a, b):
        left = a[0] <= b[0]
        return np.where(left, a[0], b[0]), np.where(left, a[1], b[1])

    def moved(m, by):
        return np.roll(m[0], -by), np.roll(m[1], -by)

    best, span = (grams, np.arange(len(grams))), 1
    while span * 2 <= width:
        best, span = better(best, moved(best, span)), span * 2
    return better(best, moved(best, width - span)) if span < width else best


class _Windows:
    """The windows of a chunk: start, text, hash and anchor of each, in order."""

    def __init__(self, t: tx.Texts, length: int, seed: int):
        self.words = tx.words(t)
        h = tx.span_hashes(t.data, self.words.starts, self.words.ends)
        ok = tx.complete(self.words, length)
        self.start = np.flatnonzero(ok)
        self.own = self.words.text_of()[ok]
        self.hash = tx.ngram_hashes(h, length)[ok]
        value, place = _smallest(tx.ngram_hashes(h, seed), length - seed + 1)
        self.anchor, self.place = value[ok], place[ok]

    def seeds(self) -> np.ndarray:
        """One anchor value per occurrence in the texts."""
        fresh = np.ones(len(self.place), bool)
        fresh[1:] = self.place[1:] != self.place[:-1]
        return self.anchor[fresh]


def _keyed(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    return tx.mixed(hashes + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _seeds(length: int, seed: int):
    def work(batch, t):
        keys, n = np.unique(_Windows(t, length, seed).seeds(), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return tx.per_chunk(work)


def _extended(bits, length: int, seed: int):
    def work(batch, t):
        v = _Windows(t, length, seed)
        near = shared.maybe(bits.value, v.anchor)
        h, own = v.hash[near], v.own[near]
        _, first = np.unique(_keyed(h, own), return_index=True)
        ids = batch.column("doc_id").take(pa.array(own[first]))
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), ids], ["key", "doc_id"])

    return tx.per_chunk(work)


def _repeats_of(batch: pa.RecordBatch, t: tx.Texts, bits: np.ndarray, length: int, seed: int) -> tuple[_Windows, np.ndarray]:
    """The windows of a chunk and which of them are repeats, given each row's own first windows."""
    v = _Windows(t, length, seed)
    near = np.flatnonzero(shared.maybe(bits, v.anchor))
    key = _keyed(v.hash[near], v.own[near])
    _, first = np.unique(key, return_index=True)
    earliest = np.zeros(len(near), bool)
    earliest[first] = True
    lists = batch.column("firsts")
    held = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(t)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    repeat = np.zeros(len(v.start), bool)
    repeat[near] = ~(earliest & np.isin(key, _keyed(held, owner)))
    repeat &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[v.own]
    return v, repeat


def _with_firsts(docs: DataFrame, length: int, seed: int):
    """Documents with the windows whose first holder they are, and the seed bits."""
    rows = tx.documents(docs)
    bits = shared.send(docs, shared.repeated(rows.mapInArrow(_seeds(length, seed), "key long, n long")))
    extended = rows.where("doc_id IS NOT NULL").mapInArrow(_extended(bits, length, seed), "key long, doc_id long")
    first = extended.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    lists = first.groupBy("doc_id").agg(F.collect_list("key").alias("firsts"))
    return rows.join(lists, "doc_id", "left"), bits


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, first word and number of words of every maximal repeated span."""
    joined, bits = _with_firsts(docs, length, seed)

    def work(batch, t):
        v, repeat = _repeats_of(batch, t, bits.value, length, seed)
        at, own = v.start[repeat], v.own[repeat]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] > at[:-1] + length) | (own[1:] != own[:-1])
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], len(at)) - 1 if len(at) else begin
        ids = batch.column("doc_id").take(pa.array(own[begin]))
        start = at[begin] - v.words.first[own[begin]]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(start), pa.array(at[last] + length - at[begin])], ["doc_id", "first_word", "n_words"])

    return joined.mapInArrow(tx.per_chunk(work), "doc_id long, first_word long, n_words long")


def dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept_text``: the words outside repeats, joined by one space."""
    joined, bits = _with_firsts(docs, length, seed)

    def work(batch, t):
        v, repeat = _repeats_of(batch, t, bits.value, length, seed)
        n = len(v.words.starts)
        edge = np.zeros(n + length + 1, np.int64)
        np.add.at(edge, v.start[repeat], 1)
        np.add.at(edge, v.start[repeat] + length, -1)
        kept = np.cumsum(edge)[:n] == 0
        removed = np.concatenate(([0], np.cumsum(~kept)))[v.words.first]
        raw, texts = t.data.tobytes(), []
        starts, ends = v.words.starts.tolist(), v.words.ends.tolist()
        for a, b in zip(v.words.first[:-1].tolist(), v.words.first[1:].tolist()):
            texts.append(b" ".join([raw[starts[i] : ends[i]] for i in (a + np.flatnonzero(kept[a:b])).tolist()]).decode())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(v.words.counts()), pa.array(np.diff(removed)), pa.array(texts, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(tx.per_chunk(work), "doc_id long, n_words long, n_removed long, kept_text string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words and removed words of every document, and the hash of what it keeps."""
    rows = dedup(tx.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: DuckDB: every window of every text, first holder by (doc_id, start).
OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, s, md5(array_to_string(words[s:s + 19], ' ')) AS h FROM w, unnest(range(1, len(words) - 18)) AS u(s)),
dup AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM dup, unnest(range(0, 20)) AS v(k)),
l AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
k AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN words
      ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i])
    END AS kept
  FROM w LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""
