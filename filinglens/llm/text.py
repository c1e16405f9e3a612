"""Words, hashes and n-grams of whole Arrow text columns, computed on byte arrays.

Texts stay UTF-8 bytes. A word is a maximal run of bytes that are no separator;
its hash is a polynomial over the bytes modulo 2**64, finished by a bit mixer.
Chunks bound the memory: a chunk holds whole texts of about ``CHUNK`` bytes, or
one longer text.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


class Texts(NamedTuple):
    """Texts of consecutive rows: bytes, and where each text begins and ends."""

    row: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    """Byte bounds of the words, and the index of the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def texts(column: pa.Array, chunk: int = CHUNK) -> Iterator[Texts]:
    """Chunks of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        yield Texts(row, data[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row])
        row = upto


def words(t: Texts, separator: np.ndarray = SEPARATOR) -> Words:
    """Maximal runs of non-separators; a text's end always ends a word."""
    inside = ~separator[t.data]
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = t.offsets[1:-1]
    before[cut[cut < len(inside)]] = False
    after[cut[cut > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, t.offsets))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)


class Hasher:
    """Hashes of any byte spans of one array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _upto(max(1, len(data) + 1))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span."""
    return Hasher(data)(starts, ends)


def ngram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions wrap and mean nothing."""
    out = np.zeros(len(hashes), np.uint64)
    for i in range(k):
        out = out * _STEP + (np.roll(hashes, -i) if i else hashes)
    return mixed(out)


def complete(w: Words, k: int) -> np.ndarray:
    """Whether k words of the same text begin at each position."""
    last = np.repeat(w.first[1:], w.counts())
    return np.arange(len(last)) + k <= last


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column out of consecutive values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def per_chunk(work: Callable[[pa.RecordBatch, Texts], pa.RecordBatch | None], column: str = "text") -> Callable:
    """A mapInArrow function that hands ``work`` the rows of one chunk at a time."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for t in texts(batch.column(at)):
                out = work(batch.slice(t.row, len(t)), t)
                if out is not None and out.num_rows:
                    yield out

    return run


class Sent:
    """A broadcast of any object, by value: the workers need not be able to import its class."""

    def __init__(self, df: DataFrame, value):
        self.raw = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))
        self.kept: list = []

    def __getstate__(self):
        return {"raw": self.raw, "kept": []}

    @property
    def value(self):
        if not self.kept:
            self.kept.append(pickle.loads(self.raw.value))
        return self.kept[0]


def fresh_name(stem: str) -> str:
    """A folder name that no other run takes."""
    return f"{stem}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame, salt: str = "") -> Column:
    """A hash of all columns of a row that can be hashed, nulls told apart."""
    columns = [F.col(f"`{f.name}`") for f in df.schema if not re.search("map<|variant", f.dataType.simpleString())]
    return F.xxhash64(F.lit(salt), *columns, *[c.isNull() for c in columns])


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long and text, whatever else the table has."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
