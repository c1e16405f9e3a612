"""Session defaults shared by tests, bench and interactive use."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "filinglens", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FILINGLENS_DRIVER_MEMORY", "12g"))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session that names none gets a fresh local folder; a cluster
    without one is refused, as its executors share no local disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context_dir = spark.sparkContext.getCheckpointDir()
        if not context_dir and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = context_dir or tempfile.mkdtemp(prefix="filinglens-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has finished."""
    files, place = _place(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    files, place = _place(spark, path)
    files.delete(place, True)


#: Spark deletes the shuffle files of an action at its end.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession):
    """Actions in here leave no shuffle files behind; for plans that run once, such as a write."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


class Scratch:
    """Intermediate tables of one run, in a folder of their own below ``shared_dir``.

    ``keep`` writes a frame and reads it again, which cuts its lineage as a
    checkpoint does, but compressed and column by column; what the write shuffled
    is deleted with it. ``drop`` deletes kept tables that no later step reads;
    what a returned frame still reads has to stay.
    """

    def __init__(self, spark: SparkSession, stem: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
        self.kept: list[tuple[DataFrame, str]] = []
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.made}"
        self.made += 1
        with freed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame, path in [k for k in self.kept if any(k[0] is f for f in frames)]:
            remove(self.spark, path)
            self.kept.remove((frame, path))

    def clear(self) -> None:
        """Drop every kept table."""
        self.drop(*[frame for frame, _ in self.kept])
