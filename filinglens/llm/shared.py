"""Which 64-bit keys occur more than once, as one bit array of fixed size.

The keys of a whole corpus are counted by a Spark aggregate with map-side
combine, so a hot key is one row per task. Those that are shared set bits of an
array of ``BITS`` bits, which is all that reaches the driver and the executors:
its size does not grow with the data. Keys may share a bit, so a set bit only
says "maybe shared"; every user of it checks exactly afterwards, and a full
array costs speed, not results.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**26 bits are 8 MB on the driver and on each worker.
BITS = 1 << 26
_PART = 1 << 15


def bit_array(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The array of the distinct ``key`` values of a frame, as bytes."""
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    rows = (
        keys.select(F.shiftright(place, 15).cast("int").alias("part"), place.bitwiseAND(F.lit(_PART - 1)).alias("at"))
        .groupBy("part").agg(F.bitmap_construct_agg("at").alias("map"))
    )
    out = np.zeros(bits // 8, np.uint8)
    for part, chunk in rows.collect():
        out[part * _PART // 8 : (part + 1) * _PART // 8] = np.frombuffer(bytes(chunk), np.uint8)
    return out


def levels(keys: DataFrame, steps: tuple[int, ...], bits: int = BITS) -> np.ndarray:
    """One row of bits per step: the keys that ``keys`` (key long, n long) counts at least that often."""
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    counted = keys.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= steps[0])
    level = sum((F.col("n") >= s).cast("int") for s in steps[1:]) + F.lit(0)
    rows = (
        counted.select(level.alias("level"), F.shiftright(place, 15).cast("int").alias("part"),
                       place.bitwiseAND(F.lit(_PART - 1)).alias("at"))
        .groupBy("level", "part").agg(F.bitmap_construct_agg("at").alias("map"))
    )
    out = np.zeros((len(steps), bits // 8), np.uint8)
    for level_, part, chunk in rows.collect():
        out[level_, part * _PART // 8 : (part + 1) * _PART // 8] = np.frombuffer(bytes(chunk), np.uint8)
    return out


def maybe(array: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    place = keys & np.uint64(len(array) * 8 - 1)
    return (array[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def send(df: DataFrame, array: np.ndarray) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(array)


def repeated(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bits of the keys that ``keys`` (key long, n long) counts twice or more."""
    return bit_array(keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), bits)


def spread(keys: DataFrame, label: Column, bits: int = BITS) -> np.ndarray:
    """Bits of the keys that rows of more than one label hold."""
    found = keys.groupBy("key").agg(F.min(label).alias("low"), F.max(label).alias("high"))
    return bit_array(found.where("low < high"), bits)
