"""The corpus pipeline: five stages from ``documents`` to sharded training text.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which the driver writes as Parquet and reads again as the
next one's ``docs``. All but the last return the columns of ``documents``.

1. quality: documents that the classifier scores below its threshold go.
2. near_duplicates: of each component of the Jaccard join, one row stays, of the smallest doc_id.
3. decontamination: documents that leak a benchmark item go.
4. mixing: rates keep the tokens of the clean and low domains and bring the toxic
   domain's towards none; each row is written as often as its rate, its fraction
   drawn by a hash of the row.
5. sharding: each document gets its slot and shard.

Stage 2 goes by rows: an id with two texts has two places, and rows without a
doc_id take part. Rows without words stay in it. Extra columns pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filinglens.llm import decontamination, jaccard_join, mixing, quality_classifier, sharding
from filinglens.llm import text as tx
from filinglens.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above, by a model of this corpus's labelled rows."""
    labels = tx.table(spark, sf_dir, "labels")
    weights = quality_classifier.fit(docs, labels.where(~quality_classifier.held_out("doc_id")))
    return quality_classifier.kept(docs, weights)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component."""
    return jaccard_join.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontamination.clean(docs, tx.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The clean and low domains at their present totals, the toxic domain at none."""
    return mixing.mixed(docs, tx.table(spark, sf_dir, "labels"), mixing.by_multiples({"clean": 1.0, "low": 1.0, "toxic": 0.0}))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard."""
    return sharding.assign(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard),
]

#: Trained models decide three of the stages, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/{tx.fresh_name('pipeline')}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
