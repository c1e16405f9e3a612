"""The media scoring job with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.text import ticker_mentions

Scorer = Callable[[DataFrame], DataFrame]


def word_list_scorer(media: DataFrame) -> DataFrame:
    """(media_id, label, confidence) from the balance of listed words.

    Words are counted with a fixed map inside the row; no token leaves it. The
    confidence is the share of the majority side among the listed words found.
    """
    table = F.create_map(*[F.lit(v) for kv in K.SENTIMENT_WORDS.items() for v in kv])
    words = F.split(F.lower("content"), r"[^\p{L}]+")
    signs = F.filter(F.transform(words, lambda w: table[w]), lambda s: s.isNotNull())
    df = media.select("media_id", signs.alias("s")).select(
        "media_id", F.size(F.filter("s", lambda x: x > 0)).alias("up"), F.size(F.filter("s", lambda x: x < 0)).alias("down"))
    label = F.when(F.col("up") > F.col("down"), "positive").when(F.col("down") > F.col("up"), "negative").otherwise("neutral")
    share = F.greatest("up", "down") / F.greatest(F.col("up") + F.col("down"), F.lit(1))
    return df.select("media_id", label.alias("label"), share.alias("confidence"))


def score_media(
    media: DataFrame, sentiment: DataFrame, scorer: Scorer = word_list_scorer, model: str = "wordlist",
) -> DataFrame:
    """Analyses of media the model has not seen: signed score, label, tickers.

    Positive labels score +confidence, negative ones -confidence, others 0;
    blank content is neutral with confidence 0.
    """
    from ..plans.read_api import unanalysed_media

    todo = unanalysed_media(media, sentiment, model).select("media_id", "content")
    blank = F.trim(F.regexp_replace("content", r"\s+", " ")) == ""
    scored = scorer(todo.filter(~blank)).join(todo, "media_id")
    empty = todo.filter(blank).select(
        "media_id", F.lit("neutral").alias("label"), F.lit(0.0).alias("confidence"), "content")
    both = scored.select("media_id", "label", "confidence", "content").unionByName(empty)
    sign = F.when(F.col("label") == "positive", 1.0).when(F.col("label") == "negative", -1.0).otherwise(0.0)
    return both.select(
        "media_id", F.lit(model).alias("model_name"), F.col("label").alias("sentiment_label"),
        (sign * F.col("confidence")).alias("sentiment_score"), "confidence",
        ticker_mentions("content").alias("tickers_extracted"))
