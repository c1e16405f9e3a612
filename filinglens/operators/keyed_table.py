"""A Parquet table in buckets by the hash of its key, changed batch by batch.

A batch reads and rewrites only the buckets that its keys fall into: the filter on
the bucket is a partition filter, and the write replaces partitions dynamically.
Other buckets keep their files. ``buckets`` is fixed for the life of a table; choose
it so that one bucket is about a gigabyte at the size expected.

The new content of the buckets is first written beside the table and published from
there. If a job dies while it publishes, the same batch run again finds this copy
complete and publishes it once more, so a batch counts once however often it is run,
rows without a key included. A batch that failed has to be run again before the
next one, as a stream does by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import remove, written

BUCKET = "_bucket"
Step = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """``keys`` place a row; a merge on these or on more columns finds all it needs in the row's bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str], buckets: int = 64):
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        # files may lack a value in any column, whatever the staged rows promise
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        empty = spark.createDataFrame([], self._stored())
        empty.write.mode("ignore").partitionBy(BUCKET).parquet(path)

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType(), True)])

    def _staged(self, batch: int) -> str:
        return f"{self.path}-staged/{batch}"

    def bucket(self) -> Column:
        """The bucket of a row, from its key; nulls have their place too."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows, of all buckets or of some. A frame is good until the next batch replaces its files."""
        rows = self.spark.read.schema(self._stored()).parquet(self.path)
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(list(buckets)))
        return rows.drop(BUCKET)

    def apply(self, staged: DataFrame, step: Step, batch: int) -> list[int]:
        """Replace the buckets of the staged keys by ``step(their rows, staged)``; returns these buckets.

        ``step`` may add and change rows but has to leave a bucket's keys in it. Batches
        are numbered upwards by one. A batch without rows changes nothing.
        """
        place = self._staged(batch)
        if not written(self.spark, place):
            staged = staged.persist()
            try:
                touched = [r[0] for r in staged.select(self.bucket().alias(BUCKET)).distinct().collect()]
                if not touched:
                    return []
                rows = step(self.read(touched), staged).select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
                # splits a bucket that holds a large share of the rows, joins small ones
                rows = rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET)
                rows.write.mode("overwrite").partitionBy(BUCKET).parquet(place)
            finally:
                staged.unpersist()
            # the batch before is published, or this one would not have been started
            remove(self.spark, self._staged(batch - 1))
        return self._publish(place)

    def _publish(self, place: str) -> list[int]:
        rows = self.spark.read.schema(self._stored()).parquet(place)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
