"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: a
permutation given by an offset and a step from its name's hash. The shards take
turns, each claiming its next free slot, until the table is full, so the shares
of any two shards differ by at most one slot (by weight, if weighted), and adding
or losing a shard moves few slots. A key's slot is its hash modulo the table
size; the broadcast table, whose size is a parameter and not the data's, gives
its shard in constant time. Placement is by key alone, so it needs no shuffle.

A null key is placed like the empty string. Repeated keys share a shard. An empty
table gives no rows. Other columns pass through; ``slot`` and ``shard`` replace
columns of these names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import text as tx

SLOTS = 65537
N_SHARDS = 64


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index of each slot. Turns go round by name, so the order of ``names`` does not matter."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names, one at least")
    if not _prime(slots) or slots < len(names):
        raise ValueError("the table size must be a prime, and no smaller than the number of shards")
    order = sorted(range(len(names)), key=lambda i: names[i])
    place = [_hash(n, "offset") % slots for n in names]
    step = [_hash(n, "step") % (slots - 1) + 1 for n in names]
    table, free = [-1] * slots, slots
    while free:
        for i in order:
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's MD5, modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign(df: DataFrame, key: str = "doc_id", shards: int | list[str] = N_SHARDS, slots: int = SLOTS) -> DataFrame:
    """The rows with ``slot`` and ``shard`` (the shard's index)."""
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    table = df.sparkSession.createDataFrame(list(enumerate(fill(names, slots))), "slot int, shard int")
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in rows.columns], "shard")


def balance(assigned: DataFrame) -> DataFrame:
    """Rows and characters per shard."""
    return assigned.groupBy("shard").agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n_chars"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document, with its source and length for the manifest."""
    rows = tx.table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("text_chars"))
    return assign(rows).select("doc_id", "source", "text_chars", "slot", "shard")
