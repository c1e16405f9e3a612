"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features of a text, hashed into ``DIM`` places: its words, its word pairs, the
shapes of its words (letters as a or A, digits as 9, runs as one, marks as they
are) and its shape pairs, which also say whether a word repeats the one before.
A place's value is its count over the number of words. The score is the logistic
function of one sparse dot product, over whole texts.

Training is follow-the-regularised-leader (proximal, per-coordinate rates). The
labelled rows are dealt to ``SHARDS`` groups; each runs its epochs in one task
and the weights are averaged. At most about ``MAX_LABELLED`` labelled rows are
used: where the table has more, a hash of doc_id picks them. Everything else
covers all rows.

A null or empty text has only the bias. Without any usable label every score is
0.5. Labels that are null are left out; repeated label rows count repeatedly.
Label, language, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import text as tx

DIM = 1 << 18
MAX_LABELLED = 20000
SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 0.1, 0.002, 0.0
THRESHOLD = 0.3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 57
_SHAPE[128:] = 97


def shapes(t: tx.Texts, w: tx.Words) -> np.ndarray:
    kind = _SHAPE[t.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[w.starts] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    return tx.span_hashes(kind[keep], at[w.starts], at[w.ends])


def places(t: tx.Texts, dim: int = DIM) -> tuple[tx.Words, list[np.ndarray]]:
    """Per word four feature places; the last word of a text has none for its pairs (place ``dim``)."""
    w = tx.words(t)
    h, shape = tx.span_hashes(t.data, w.starts, w.ends), shapes(t, w)
    pair = tx.complete(w, 2)
    again = h == np.roll(h, -1)
    kinds = [
        (h, None), (tx.ngram_hashes(h, 2), pair), (shape, None),
        (tx.ngram_hashes(shape, 2) + again.astype(np.uint64), pair),
    ]
    out = []
    for i, (value, ok) in enumerate(kinds):
        place = (tx.mixed(value + np.uint64(i + 1)) & np.uint64(dim - 1)).astype(np.int64)
        out.append(place if ok is None else np.where(ok, place, dim))
    return w, out


def _examples(dim: int):
    def work(batch, t):
        w, kinds = places(t, dim)
        own = np.tile(w.text_of(), len(kinds))
        key, n = np.unique(own * (dim + 1) + np.concatenate(kinds), return_counts=True)
        own, place = key // (dim + 1), key % (dim + 1)
        real = place < dim
        own, place, n = own[real], place[real], n[real]
        value = n / np.maximum(1, w.counts())[own]
        counts = np.bincount(own, minlength=len(t))
        return pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("label"), tx.ragged(place.astype(np.int32), counts, pa.int32()),
             tx.ragged(value.astype(np.float32), counts, pa.float32())], ["shard", "label", "place", "value"])

    return tx.per_chunk(work)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def leader(rows, dim: int, epochs: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """FTRL-proximal weights of examples (place, value, label); the bias is the last place."""
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            place, value, label = rows[i]
            w = weights(place)
            g = (sigmoid(float(w @ value)) - label) * value
            step = (np.sqrt(n[place] + g * g) - np.sqrt(n[place])) / alpha
            z[place] += g - step * w
            n[place] += g * g
    return weights(np.arange(dim + 1))


def _fit_shard(dim: int, epochs: int):
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (np.append(p, dim).astype(np.int64), np.append(v, 1.0), float(y))
            for p, v, y in zip(frame["place"], frame["value"], frame["label"])
        ]
        rows.sort(key=lambda r: (r[2], len(r[0]), r[0][:8].tolist()))  # the same order, however the rows arrive
        w = leader(rows, dim, epochs)
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at.astype(np.int32), "weight": w[at]})

    return fit


def part(column, n: int):
    """0 to n - 1, by a hash of an id."""
    return F.pmod(F.xxhash64(column), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", dim: int = DIM, max_labelled: int = MAX_LABELLED,
        shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the places, the bias last. The labelled ids, of bounded number, are broadcast to the scan of texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    total = known.count()
    if total > max_labelled:
        share = int(max_labelled / total * (1 << 30))
        known = known.where(part(F.concat_ws("-", F.lit("fit"), F.col("doc_id")), 1 << 30) < share)
    known = known.withColumn("shard", part("doc_id", shards).cast("int"))
    rows = tx.documents(docs).join(F.broadcast(known), "doc_id")
    examples = rows.select("shard", "label", "text").mapInArrow(
        _examples(dim), "shard int, label int, place array<int>, value array<float>")
    fitted = examples.groupBy("shard").applyInPandas(_fit_shard(dim, epochs), "place int, weight double")
    mean = fitted.groupBy("place").agg((F.sum("weight") / shards).alias("weight"))
    out = np.zeros(dim + 1)
    for place, weight in mean.collect():  # at most one row per place
        out[place] = weight
    return out


class Scorer:
    """Scores of the texts of a chunk under broadcast weights."""

    def __init__(self, df: DataFrame, weights: np.ndarray):
        self.dim, self.bias = len(weights) - 1, float(weights[-1])
        self.table = df.sparkSession.sparkContext.broadcast(np.append(weights[:-1], 0.0))

    def __call__(self, t: tx.Texts) -> np.ndarray:
        w, kinds = places(t, self.dim)
        total = np.concatenate(([0.0], np.cumsum(sum(self.table.value[k] for k in kinds))))
        x = (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(1, w.counts())
        return sigmoid(x + self.bias)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row."""
    model = Scorer(docs, weights)

    def work(batch, t):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model(t))], ["doc_id", "score"])

    return tx.documents(docs).mapInArrow(tx.per_chunk(work), "doc_id long, score double")


def kept(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose texts score at the threshold or above, in one pass."""
    model = Scorer(docs, weights)

    def work(batch, t):
        return batch.filter(pa.array(model(t) >= threshold))

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(tx.per_chunk(work), rows.schema)


def held_out(column):
    """The contract's fold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of the held-out fold are never read into the model."""
    docs, labels = tx.table(spark, sf_dir, "documents"), tx.table(spark, sf_dir, "labels")
    weights = fit(docs, labels.where(~held_out("doc_id")))
    return score(docs, weights).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
