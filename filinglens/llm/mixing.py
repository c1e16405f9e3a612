"""Mixing to target weights by soft membership.

1. A classifier trained on the labels table gives each document a posterior over
   the domains ``clean``, ``low`` and ``toxic``: two logistic models over the
   distinct hashed words, word beginnings and word shapes of the text, trained by
   FTRL with L1, for toxic and for low quality; clean is neither.
2. A document of t words brings rate * t * p[k] expected tokens to domain k. Rates
   start at 1 and follow projected gradient steps on the squared misses of the
   domain totals, each over the domain's present total, in the metric that weighs a
   rate by its tokens, so that equal posteriors get equal rates. A step needs only
   the domain totals, which Spark sums; no document reaches the driver. A rate is a
   function of the posterior, so a later pass over the texts applies it without a
   join.

At most about ``MAX_LABELLED`` labelled rows train the classifier (picked by a
hash of doc_id where there are more); every document counts in the totals.

3. ``mixed`` writes a row as often as its rate: the whole part, and one more where
   a hash of the row lies below the fraction, so the written tokens meet the totals.

A null or empty text has no tokens: its rate follows its prior posterior and adds
nothing. Without labels every posterior is the prior of an untrained model. A
domain without tokens cannot be raised and is left out of the fit. Repeated rows
count repeatedly. Columns of the documents pass through ``mixed`` unchanged.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import quality_classifier as qc
from filinglens.llm import text as tx
from filinglens.session import durable

_LOG = logging.getLogger(__name__)

DOMAINS = ("clean", "low", "toxic")
#: Target shares of all tokens of the registered query.
WEIGHTS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
DIM = 1 << 18
MAX_LABELLED = 20000
SHARDS, EPOCHS = 4, 4
RATES = {"alpha": 0.5, "beta": 1.0, "l1": 0.5, "l2": 0.0}
#: The fit ends when every total is this close to its target, or after so many steps, which it then says.
STEPS, CLOSE = 40, 1e-4
#: Bytes of word beginnings that are features, for words that are longer.
BEGINNINGS = (4, 7)
#: Bounds, in percent of the words, between the places for texts that repeat words in a row.
REPEATS = (1, 2, 4, 8, 16)


def _places(t: tx.Texts, dim: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and place of the distinct features of each text (only those wanted), and its number of words."""
    w = tx.words(t)
    hasher = tx.Hasher(tx.LOWER[t.data])
    lower = hasher(w.starts, w.ends)
    own, counts = w.text_of(), w.counts()
    pair = tx.complete(w, 2)
    again = np.bincount(own[pair & (lower == np.roll(lower, -1))], minlength=len(t))
    step = np.searchsorted(np.array(REPEATS), 100 * again / np.maximum(1, counts), "right")
    kinds = [(lower, own), (qc.shapes(t, w), own), (step.astype(np.uint64), np.arange(len(t)))]
    for size in BEGINNINGS:
        longer = w.ends - w.starts > size
        kinds.append((hasher(w.starts[longer], w.starts[longer] + size), own[longer]))
    keys = []
    for i, (values, owner) in enumerate(kinds):
        place = (tx.mixed(values + np.uint64(i * 977)) & np.uint64(dim - 1)).astype(np.int64)
        if wanted is not None:
            near = wanted[place]
            owner, place = owner[near], place[near]
        keys.append(owner * dim + place)
    key = np.unique(np.concatenate(keys))
    return key // dim, key % dim, counts


def _examples(dim: int):
    def work(batch, t):
        own, place, _ = _places(t, dim)
        counts = np.bincount(own, minlength=len(t))
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("shard", "low", "toxic")), tx.ragged(place.astype(np.int32), counts, pa.int32())],
            ["shard", "low", "toxic", "place"])

    return tx.per_chunk(work)


def _fit_shard(dim: int, epochs: int):
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for model in ("low", "toxic"):
            rows = [
                (np.append(p, dim).astype(np.int64), np.ones(len(p) + 1), float(y)) for p, y in zip(frame["place"], frame[model])]
            rows.sort(key=lambda r: (r[2], len(r[0]), r[0][:8].tolist()))  # the same order, however the rows arrive
            w = qc.leader(rows, dim, epochs, **RATES)
            at = np.flatnonzero(w)
            out.append(pd.DataFrame({"model": model, "place": at.astype(np.int32), "weight": w[at]}))
        return pd.concat(out)

    return fit


def classifier(docs: DataFrame, labels: DataFrame, dim: int = DIM, max_labelled: int = MAX_LABELLED, shards: int = SHARDS,
               epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the models for low quality and toxic; the bias last. The labelled ids, of bounded number, are broadcast."""
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality").cast("int") == 0).cast("int").alias("low"),
        (F.col("toxic").cast("int") == 1).cast("int").alias("toxic")).dropna()
    total = known.count()
    if total > max_labelled:
        known = known.where(
            qc.part(F.concat_ws("-", F.lit("mix"), F.col("doc_id")), 1 << 30) < int(max_labelled / total * (1 << 30)))
    known = known.withColumn("shard", qc.part("doc_id", shards).cast("int"))
    rows = tx.documents(docs).join(F.broadcast(known), "doc_id").select("shard", "low", "toxic", "text")
    examples = rows.mapInArrow(_examples(dim), "shard int, low int, toxic int, place array<int>")
    fitted = examples.groupBy("shard").applyInPandas(_fit_shard(dim, epochs), "model string, place int, weight double")
    mean = fitted.groupBy("model", "place").agg((F.sum("weight") / shards).alias("weight"))
    out = np.zeros((2, dim + 1))
    for model, place, weight in mean.collect():  # at most one row per model and place
        out[("low", "toxic").index(model), place] = weight
    return out


def posteriors(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns in ``keep``, the words of the text, and its posterior over DOMAINS, under the prefix ``_mix_``."""
    dim = weights.shape[1] - 1
    model = docs.sparkSession.sparkContext.broadcast(weights)
    names = [*keep, "_mix_tokens", *(f"_mix_{d}" for d in DOMAINS)]

    def work(batch, t):
        w = model.value
        own, place, counts = _places(t, dim, (w[0, :dim] != 0) | (w[1, :dim] != 0))
        low, toxic = (qc.sigmoid(np.bincount(own, m[place], len(t)) + m[dim]) for m in w)
        columns = [counts, (1 - toxic) * (1 - low), (1 - toxic) * low, toxic]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c) for c in columns)], names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "_mix_tokens long", *(f"_mix_{d} double" for d in DOMAINS)])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_mix_text"))
    return rows.mapInArrow(tx.per_chunk(work, "_mix_text"), schema)


def rate(steps: list[list[float]]) -> Column:
    """The rate of a document, from its posterior and the steps taken."""
    out = F.lit(1.0)
    for step in steps:
        move = sum((F.lit(c) * F.col(f"_mix_{d}") for c, d in zip(step, DOMAINS)), F.lit(0.0))
        out = F.greatest(F.lit(0.0), out - move)
    return out


def fit_rates(rows: DataFrame, targets) -> list[list[float]]:
    """Projected gradient steps until every domain total is ``CLOSE`` to its target; a warning gives the gap if none is.

    ``targets`` maps the present totals by domain to the wanted ones.
    """
    p = [F.col(f"_mix_{d}") for d in DOMAINS]
    tokens = F.col("_mix_tokens")
    sums = [F.coalesce(F.sum(tokens * a), F.lit(0.0)) for a in p] + [
        F.coalesce(F.sum(tokens * a * b), F.lit(0.0)) for a in p for b in p]
    found = np.array(rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first(), float)
    k = len(DOMAINS)
    present, gram = found[:k], found[k:].reshape(k, k)
    wanted_by = targets(dict(zip(DOMAINS, present)))
    wanted = np.array([wanted_by[d] for d in DOMAINS])
    scale = np.where(present > 0, 1 / np.sqrt(np.maximum(present, 1e-9)), 0.0)
    top = float(np.linalg.eigvalsh(gram * np.outer(scale, scale)).max())
    if top <= 0:
        return []
    steps: list[list[float]] = []
    totals = present
    for n in range(STEPS + 1):
        miss = (totals - wanted) * scale * scale  # as shares of the present totals
        if np.abs(miss).max() < CLOSE:
            break
        if n == STEPS:
            _LOG.warning("after %d steps the totals miss their targets by these shares: %s", n, dict(zip(DOMAINS, miss.tolist())))
            break
        steps.append((miss / top).tolist())
        r = rate(steps)
        totals = np.array(rows.agg(*[F.sum(tokens * a * r).alias(f"s{i}") for i, a in enumerate(p)]).first(), float)
    return steps


def by_weights(weights: dict[str, float]):
    """Targets as shares of all present tokens."""
    return lambda present: {d: weights.get(d, 0.0) * sum(present.values()) for d in DOMAINS}


def by_multiples(multiples: dict[str, float]):
    """Targets as multiples of each domain's present tokens."""
    return lambda present: {d: multiples.get(d, 1.0) * v for d, v in present.items()}


def copies(docs: DataFrame, rate: Column) -> Column:
    """How often a row is written: its rate's whole part, once more if its hash lies below the fraction."""
    draw = F.pmod(tx.row_hash(docs, "mix"), F.lit(1 << 30)) / F.lit(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets) -> DataFrame:
    """The documents' own columns, each row as often as its rate says on average."""
    weights = classifier(docs, labels)
    steps = fit_rates(durable(posteriors(docs, weights, [])), targets)
    rows = posteriors(docs, weights, docs.columns)
    rows = rows.withColumn("_mix_copies", copies(docs, rate(steps))).where("_mix_copies > 0")
    rows = rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, posterior and rate of every document, towards WEIGHTS."""
    docs, labels = tx.table(spark, sf_dir, "documents"), tx.table(spark, sf_dir, "labels")
    rows = durable(posteriors(docs.withColumn("doc_id", F.col("doc_id").cast("long")), classifier(docs, labels), ["doc_id"]))
    steps = fit_rates(rows, by_weights(WEIGHTS))
    return rows.select(
        "doc_id", F.col("_mix_tokens").alias("n_tokens"), *[F.col(f"_mix_{d}").alias(f"p_{d}") for d in DOMAINS],
        rate(steps).alias("rate"))
