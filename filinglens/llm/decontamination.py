"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items become passages of at most ``WINDOW`` words. Words are weighed
   by their inverse document frequency over all documents. An item's content words
   are those in at most ``CONTENT`` of the documents, or in no more than its median
   word (an item that leaks often is not common language), or all if these are fewer
   than 3; words that are no item's content weigh nothing. The whole passages of an
   item longer than a window have their own content words by the same rule.
2. A distributed randomised SVD of the passages' TF-IDF matrix: partitions of
   passages add up their part of A'(A W) for a random W, twice with an
   orthogonalisation between, then the small Gram matrix that gives the axes. A
   block keeps every axis of its passages, so no passage falls outside the space.
3. Every document is cut into overlapping windows of words. Those with enough
   weight of benchmark words are projected, and passages with a cosine of
   ``COSINE`` or more, whose own weight the window covers by ``COVERAGE`` or more
   (the product before scaling over the passage's length), are candidates.
4. A candidate is checked around its window: the longest common subsequence of
   weighed words must reach ``SAME`` of the item's, or ``PARAPHRASE`` of them when at least ``ANSWER`` of
   the item's answer, the weighed words of its last sentence, occur there too. An
   item longer than a window leaks by part as well: where ``SAME`` of the content of
   one of its passages of ``WINDOW`` words is found in order, so that a run of 48
   words or more out of an item of any length is judged as one of an item of 48.

Items are worked off in blocks of bounded number and words; each block is one pass
over the documents, to which only the block's model is broadcast: the items, and
their at most ``BLOCK_WORDS`` words by as many axes as they have passages. No document meets another and no text is shuffled.

``common`` is the share of the item's content that was found, or of the passage's
where only a passage leaks. Whether a row leaks depends on its text alone: ``clean``
goes by the text's SHA-256, rows without a doc_id or with a repeated one included.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Null
or empty texts and items match nothing. Rows that repeat a doc_id or an item_id
repeat their pairs once per doc_id and item_id and row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import shared
from filinglens.llm import text as tx

WINDOW, STRIDE = 48, 24
COSINE, COVERAGE = 0.45, 0.3
MASS = 0.4
CONTENT = 0.02
SAME, PARAPHRASE, ANSWER = 0.7, 0.45, 0.8
BLOCK_ITEMS, BLOCK_WORDS = 256, 1 << 14
#: Rows of a matrix that are added up together.
PIECE = 256
_FILTER = 1 << 22

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[48:58] = _SEPARATOR[65:91] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _hashes(t: tx.Texts) -> tuple[tx.Words, np.ndarray]:
    w = tx.words(t, _SEPARATOR)
    return w, tx.span_hashes(tx.LOWER[t.data], w.starts, w.ends)


def _hashed(text: str) -> np.ndarray:
    for t in tx.texts(pa.array([text])):
        return _hashes(t)[1]
    return np.zeros(0, np.uint64)


class Vocabulary:
    """The words of a block of items: sorted hashes, a small bit filter, and their weights."""

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        self.bits = np.zeros(_FILTER // 8, np.uint8)
        place = self.words & np.uint64(_FILTER - 1)
        np.bitwise_or.at(self.bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        self.weight = np.ones(len(self.words))
        self.share = np.zeros(len(self.words))

    def index(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, or the vocabulary's size for any other."""
        out = np.full(len(h), len(self.words), np.int32)
        near = np.flatnonzero(shared.maybe(self.bits, h))
        at = np.searchsorted(self.words, h[near])
        at[at == len(self.words)] = 0
        same = self.words[at] == h[near] if len(self.words) else np.zeros(len(near), bool)
        out[near[same]] = at[same]
        return out


def _frequencies(vocabulary):
    def work(batch, t):
        w, h = _hashes(t)
        at, v = vocabulary.value.index(h), len(vocabulary.value.words)
        known = at < v
        key = np.unique(w.text_of()[known] * v + at[known])
        found, n = np.unique(key % v if v else key, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n)], ["word", "n"])

    return tx.per_chunk(work)


def weighed(docs: DataFrame, vocabulary: Vocabulary) -> Vocabulary:
    """The vocabulary with the share of documents that hold each word, and its inverse document frequency."""
    total = docs.count()
    counts = docs.mapInArrow(_frequencies(tx.Sent(docs, vocabulary)), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = np.zeros(len(vocabulary.words))
    for word, n in counts.collect():  # one row per word of the block
        df[word] = n
    vocabulary.share = df / max(1, total)
    vocabulary.weight = np.log((1 + total) / (1 + df)) + 0.1
    return vocabulary


def _row(index: list[int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One passage of the TF-IDF matrix, of length 1."""
    at, n = np.unique(np.array(index, np.int64), return_counts=True)
    value = n * weight[at]
    return at, value / max(1e-12, float(np.sqrt((value**2).sum())))


def _partial(product):
    """Adds up ``product`` (a matrix per passage) over each partition, in pieces of ``PIECE`` rows."""
    def run(batches):
        total = None
        for batch in batches:
            for index in batch.column("words").to_pylist():
                total = product(total, index)
        if total is not None:
            pieces = [total[i : i + PIECE].tobytes() for i in range(0, len(total), PIECE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "value"])

    return run


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x) for x in frame["value"])
    return pd.DataFrame({"piece": [frame["piece"].iloc[0]], "value": [total.tobytes()]})


def _summed(passages: DataFrame, product, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all passages; on the driver it is the block's words, or axes, by its axes."""
    parts = passages.select("words").mapInArrow(_partial(product), "piece int, value binary")
    rows = parts.groupBy("piece").applyInPandas(_add, "piece int, value binary").collect()
    out = np.zeros(shape)
    for r in rows:
        piece = np.frombuffer(bytes(r["value"])).reshape(-1, shape[1])
        out[r["piece"] * PIECE : r["piece"] * PIECE + len(piece)] = piece
    return out


def axes(passages: DataFrame, weight: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix by randomised SVD: words by at most ``rank``."""
    v = len(weight)
    l = min(rank + 8, v)
    basis = np.random.default_rng(seed).standard_normal((v, l))
    for _ in range(2):
        sent = tx.Sent(passages, (weight, basis))

        def add(total, index, sent=sent):
            w, b = sent.value
            total = np.zeros(b.shape) if total is None else total
            at, value = _row(index, w)
            total[at] += np.outer(value, value @ b[at])
            return total

        basis = np.linalg.qr(_summed(passages, add, (v, l)))[0]
    sent = tx.Sent(passages, (weight, basis))

    def gram(total, index):
        w, b = sent.value
        at, value = _row(index, w)
        y = value @ b[at]
        return np.outer(y, y) + (0 if total is None else total)

    values, vectors = np.linalg.eigh(_summed(passages, gram, (l, l)))
    order = np.argsort(-values)[:rank]
    return basis @ vectors[:, order[values[order] > 1e-9]]


class Model(NamedTuple):
    """What a block sends to the documents."""

    vocabulary: Vocabulary
    loading: np.ndarray
    passages: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray
    ids: list[int]
    content: list[np.ndarray]
    own: list[np.ndarray]
    answer: list[np.ndarray]
    sizes: list[int]
    mass: float


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = masks.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _cut(n: int) -> list[tuple[int, int]]:
    """Passages of an item of n words."""
    count = max(1, math.ceil((n - WINDOW) / (WINDOW // 2)) + 1) if n else 0
    return [(i * WINDOW // 2, min(n, i * WINDOW // 2 + WINDOW)) for i in range(count)]


def model(spark: SparkSession, docs: DataFrame, items: list[tuple[int, str]]) -> Model | None:
    """Vocabulary, axes and passages of one block of items."""
    hashes = [_hashed(text) for _, text in items]
    if not sum(map(len, hashes)):
        return None
    vocabulary = weighed(docs, Vocabulary(np.concatenate(hashes)))
    index = [vocabulary.index(h) for h in hashes]

    def content_of(at: np.ndarray) -> np.ndarray:
        share = vocabulary.share[at]
        rare = at[share <= max(CONTENT, float(np.median(share)))] if len(at) else at
        return rare if len(rare) >= 3 else at

    content = [content_of(at) for at in index]
    # what a passage is judged by itself on; a shorter one is judged with its item only
    parts = {(i, a): content_of(at[a:b]) for i, at in enumerate(index) for a, b in _cut(len(at)) if b - a == WINDOW < len(at)}
    used = np.zeros(len(vocabulary.words), bool)
    used[np.concatenate([*content, *parts.values()])] = True
    weight = vocabulary.weight = np.where(used, vocabulary.weight, 0.0)
    answer = []
    for _, text in items:
        last = vocabulary.index(_hashed(_SENTENCE.split(text.strip())[-1]))
        answer.append(np.unique(last[used[last]]))
    places = [(i, a, b) for i, at in enumerate(index) for a, b in _cut(len(at)) if used[at[a:b]].any()]
    rows = [(i, index[i][a:b].tolist()) for i, a, b in places]
    own = [parts.get((i, a), index[i][:0]) for i, a, _ in places]
    passages = spark.createDataFrame(rows, "item int, words array<int>")
    loading = axes(passages, weight, len(rows))
    vectors = np.array([value @ loading[at] for at, value in (_row(words, weight) for _, words in rows)])
    vectors /= np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True))
    masses = [float((weight[np.array(words)] ** 2).sum()) for _, words in rows]
    counted = [np.unique(words, return_counts=True) for _, words in rows]
    lengths = np.array([float(np.sqrt(((n * weight[at]) ** 2).sum())) for at, n in counted])
    return Model(
        vocabulary, (weight[:, None] * loading).astype(np.float32), vectors.astype(np.float32), lengths.astype(np.float32),
        np.array([i for i, _ in rows]), [i for i, _ in items], content, own, answer, [len(at) for at in index], MASS * min(masses))


def _windows(w: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of the windows of a chunk; the last one of a text may be shorter."""
    n = w.counts()
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    own = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    start = w.first[own] + nth * STRIDE
    return own, start, np.minimum(start + WINDOW, w.first[own + 1])


def _project(m: Model, at: np.ndarray, hits: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows in the latent space; ``hits`` are the places of weighed words."""
    a, b = np.searchsorted(hits, start), np.searchsorted(hits, end)
    count = b - a
    edge = np.cumsum(count) - count
    each = np.arange(count.sum()) - np.repeat(edge - a, count)
    return np.add.reduceat(m.loading[at[hits[each]]], edge, axis=0)  # every window here has a hit


def _check(m: Model, item: int, region: list[int]) -> tuple[float, float]:
    """Shares of an item's content in order, and of its answer, in a region of word numbers."""
    content, answer = m.content[item].tolist(), m.answer[item].tolist()
    same = common_subsequence(content, region) / max(1, len(content))
    held = set(region)
    return same, sum(x in held for x in answer) / len(answer) if answer else same


def _search(sent):
    def work(batch, t):
        m: Model = sent.value
        w, h = _hashes(t)
        at = m.vocabulary.index(h)
        weight = np.append(m.vocabulary.weight, 0.0)[at]
        mass = np.concatenate(([0.0], np.cumsum(weight * weight)))
        hits = np.flatnonzero(weight > 0)
        own, start, end = _windows(w)
        near = np.flatnonzero((mass[end] - mass[start] >= m.mass) & (np.searchsorted(hits, end) > np.searchsorted(hits, start)))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for i in range(0, len(near), 4096):
            part = near[i : i + 4096]
            z = _project(m, at, hits, start[part], end[part])
            product = z @ m.passages.T
            cosine = product / np.maximum(1e-12, np.linalg.norm(z, axis=1, keepdims=True))
            for j, p in np.argwhere((cosine >= COSINE) & (product >= COVERAGE * m.lengths)).tolist():
                text, item = int(own[part[j]]), int(m.item_of[p])
                before = best.get((text, item))
                if before and before[1] >= SAME:
                    continue
                reach = m.sizes[item]
                region = at[max(w.first[text], start[part[j]] - reach) : min(w.first[text + 1], end[part[j]] + reach)]
                same, answer = _check(m, item, region.tolist())
                found = same >= SAME or (same >= PARAPHRASE and answer >= ANSWER)
                if not found and len(m.own[p]) >= 3:
                    region = at[max(w.first[text], start[part[j]] - WINDOW) : min(w.first[text + 1], end[part[j]] + WINDOW)]
                    same = common_subsequence(m.own[p].tolist(), region.tolist()) / len(m.own[p])
                    found = same >= SAME
                if found:
                    if not before or same > before[1]:
                        best[text, item] = (float(cosine[j, p]), same, answer)
        if not best:
            return None
        at = pa.array([text for text, _ in best])
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column("text").take(at).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), pa.array([m.ids[item] for _, item in best], pa.int64()),
             *(pa.array(c, pa.float64()) for c in zip(*best.values())), pa.array(digests, pa.string())],
            ["doc_id", "item_id", "cosine", "common", "answer", "digest"])

    return tx.per_chunk(work)


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks with the SHA-256 of the text."""
    spark, rows = docs.sparkSession, tx.documents(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-size // (8 * BLOCK_WORDS)))
    schema = "doc_id long, item_id long, cosine double, common double, answer double, digest string"
    out = spark.createDataFrame([], schema)
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text")
        m = model(spark, rows, [tuple(r) for r in block.collect()])  # a block of bounded size
        if m:
            out = out.unionByName(rows.mapInArrow(_search(tx.Sent(rows, m)), schema))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine and the shares of content and answer found, for each leaked item of each document."""
    return _found(docs, benchmark).drop("digest")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text leaks no item. The leaks are a small side of the join; it is not broadcast by hint."""
    found = _found(docs, benchmark).select("digest").distinct()
    return docs.join(found, F.sha2(docs["text"].cast("string"), 256) == found["digest"], "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document leaks."""
    return leaks(tx.table(spark, sf_dir, "documents"), tx.table(spark, sf_dir, "benchmark"))
