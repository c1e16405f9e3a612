"""Incremental jobs as Structured Streaming queries.

Sources are landed files with an explicit schema; file-driven jobs run with
``availableNow`` and stop when the folder is drained. Checkpoints and tables
live under the shared folder the session names.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import constants as K
from ..operators import merge, signals as sig
from ..operators.keyed_table import KeyedTable, Step
from ..session import shared_dir


def read_files(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str | None = None, format: str = "parquet") -> DataFrame:
    """A stream over the files of a folder, oldest first."""
    reader = spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", 64)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a Parquet table and read it back."""
    spark = stream.sparkSession
    home = new_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{home}/_ckpt")
        .option("path", f"{home}/data").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/data")


def _merge_stream(stream: DataFrame, table: KeyedTable, step: Step) -> KeyedTable:
    """Apply each micro-batch to the buckets it hits; a batch that is run again counts once."""

    def batch(df: DataFrame, batch_id: int) -> None:
        table.apply(df, step, batch_id)

    query = (
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{table.path}-ckpt")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return table


TRADE_KEYS = ["member_name", "ticker", "transaction_date", "transaction_type", "amount_range_low"]


def filings_table(spark: SparkSession, path: str, schema: T.StructType | str, buckets: int = 64) -> KeyedTable:
    """The table that ``stream_filings`` fills, new or as an earlier run left it."""
    return KeyedTable(spark, path, schema, TRADE_KEYS, buckets)


def stream_filings(filings: DataFrame, table: KeyedTable, order: list[str] | None = None) -> KeyedTable:
    """Incremental filing ingest: new keys are inserted, known ones skipped."""
    return _merge_stream(filings, table, lambda old, new: merge.insert_new(old, new, TRADE_KEYS, order or []))


def stream_media(media: DataFrame, event_time: str = "published_at", delay: str = "7 days") -> DataFrame:
    """Media deduplicated on (source_type, source_id) within the watermark."""
    return media.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["source_type", "source_id"])


def stream_clusters(trades: DataFrame, least: int = 3, delay: str = "45 days") -> DataFrame:
    """Members per (ticker, type) in seven-day windows sliding by a day.

    Event time is the trade; filings arrive up to the delay later. Distinct
    members are counted exactly: sets of a day, sets of the window, then their sizes.
    """
    use_rocksdb(trades.sparkSession)
    timed = trades.filter("ticker is not null and member_bioguide_id is not null").withColumn(
        "at", F.to_timestamp("transaction_date")).withWatermark("at", delay)
    # members in sets by hash: a state row a set, not one a member; seven days' sets meet, not each trade in seven windows
    part = F.pmod(F.xxhash64("member_bioguide_id"), F.lit(16))
    daily = timed.groupBy(F.window("at", "1 day").alias("day"), "ticker", "transaction_type", part.alias("part")).agg(
        F.collect_set("member_bioguide_id").alias("who"), F.count("*").alias("n"))
    members = daily.groupBy(F.window("day", "7 days", "1 day"), "ticker", "transaction_type", "part").agg(
        F.array_distinct(F.flatten(F.collect_list("who"))).alias("who"), F.sum("n").alias("n"))
    return (
        members.groupBy(F.col("window"), "ticker", "transaction_type")
        .agg(F.sum(F.size("who").cast("long")).alias("members"), F.sum("n").alias("trades")).filter(F.col("members") >= least)
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "ticker",
                "transaction_type", "members", "trades"))


def stream_alerts(signals: DataFrame, configs: DataFrame) -> DataFrame:
    """Signals joined with the static configurations they match."""
    return sig.match_alerts(signals.filter("is_active"), configs)


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and list state need the RocksDB state store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _limit_processor(n: int, window_seconds: int):
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class SlidingLimit(StatefulProcessor):
        """Keeps the last n dispatch times of a configuration."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.sent = handle.getListState("sent", T.StructType([T.StructField("at", T.LongType())]))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            pending = pd.concat(list(rows)).sort_values(["created_at", "signal_id"], kind="stable")
            times = [at for (at,) in self.sent.get()] if self.sent.exists() else []
            kept = []
            micros = pending["created_at"].astype("datetime64[us]").astype("int64")
            for row, at in zip(pending.itertuples(index=False), micros):
                times = [x for x in times if x > at - window_seconds * 1_000_000]
                if len(times) < n:
                    times.append(int(at))
                    kept.append((key[0], row.signal_id, row.created_at))
            self.sent.put([(x,) for x in times])
            yield pd.DataFrame(kept, columns=["config_id", "signal_id", "created_at"])

        def close(self) -> None:
            pass

    return SlidingLimit()


def stream_rate_limit(matches: DataFrame, n: int = K.ALERTS_PER_HOUR, window_seconds: int = 3600) -> DataFrame:
    """Stateful form of the sliding-hour limit: at most n per configuration."""
    use_rocksdb(matches.sparkSession)
    slim = matches.select("config_id", "signal_id", "created_at")
    return slim.groupBy("config_id").transformWithStateInPandas(
        statefulProcessor=_limit_processor(n, window_seconds),
        outputStructType=slim.schema, outputMode="Append", timeMode="None")


def _expiry_processor():
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Expiry(StatefulProcessor):
        """Holds the signals that expire within one hour; a timer at the earliest reports all that are due."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", T.StructType(
                [T.StructField("signal_id", T.LongType()), T.StructField("at", T.LongType())]))

        def _pending(self) -> list[tuple]:
            return [(s, at) for s, at in self.waiting.get()] if self.waiting.exists() else []

        def _wait(self, pending: list[tuple]) -> None:
            if pending:
                self.waiting.put(pending)
                self.handle.registerTimer(min(at for _, at in pending))
            else:
                self.waiting.clear()

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            pending = dict.fromkeys(self._pending())
            for batch in rows:
                ids = [None if pd.isna(s) else int(s) for s in batch["signal_id"]]
                pending.update(dict.fromkeys(zip(ids, batch["due_ms"].astype("int64").tolist())))
            self._wait(list(pending))
            yield pd.DataFrame({"signal_id": pd.Series([], dtype="int64"), "expired_ms": pd.Series([], dtype="int64")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
            pending = self._pending()
            due = [(s, at) for s, at in pending if at <= now]
            if due:  # an earlier timer of this batch may have reported them
                self._wait([(s, at) for s, at in pending if at > now])
            yield pd.DataFrame({
                "signal_id": pd.Series([s for s, _ in due], dtype="Int64"),
                "expired_ms": pd.Series([at for _, at in due], dtype="int64")})

        def close(self) -> None:
            pass

    return Expiry()


def stream_expiry(signals: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(signal_id, expired_ms) once event time has passed a signal's expiry.

    Event time is the creation time of the signals seen. A signal that arrives
    already expired is reported with the next batch. State and timers are kept
    per hour of expiry, in parts by hash, not per signal.
    """
    use_rocksdb(signals.sparkSession)
    due = F.unix_millis("expires_at")
    timed = signals.filter("is_active and expires_at is not null").select(
        "signal_id", "created_at", due.alias("due_ms"), F.floor(due / 3_600_000).alias("hour"),
        F.pmod(F.xxhash64("signal_id"), F.lit(16)).alias("part")).withWatermark("created_at", delay)
    return timed.groupBy("hour", "part").transformWithStateInPandas(
        statefulProcessor=_expiry_processor(), outputStructType="signal_id long, expired_ms long",
        outputMode="Append", timeMode="EventTime")


def scores_table(spark: SparkSession, path: str, schema: T.StructType | str, buckets: int = 64) -> KeyedTable:
    """The table that ``stream_scores`` fills, placed by media_id: all models' scores of a row are in one bucket."""
    return KeyedTable(spark, path, schema, ["media_id"], buckets)


def stream_scores(media: DataFrame, table: KeyedTable, **options) -> KeyedTable:
    """Incremental media scoring into the sentiment table."""
    from ..learn.media import score_media

    def step(old: DataFrame, new: DataFrame) -> DataFrame:
        fresh = score_media(new, old, **options).select(*[f.name for f in old.schema.fields])
        return merge.upsert(old, fresh, ["media_id", "model_name"], [])

    return _merge_stream(media, table, step)


def start_alerts(signals: DataFrame, configs: DataFrame, write_batch, checkpoint: str, interval: str = "30 minutes"):
    """The standing alert job: match, limit and hand payloads to a batch writer."""
    limited = stream_alerts(signals, configs)

    def batch(df: DataFrame, batch_id: int) -> None:
        write_batch(sig.alert_payloads(sig.rate_limit(df)), batch_id)

    return (
        limited.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval).start())
