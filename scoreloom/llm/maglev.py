"""Sharding by a permutation-filled lookup table, in DataFrame operations only.

Each shard has a preference order over the slots of a prime-sized table (an offset and a step, from its name's hash);
shards take turns, heavier ones more often, to claim the first free slot of their order. A document's hash names a
slot, the slot its shard: constant time, even shares, and few documents move when a shard comes or goes.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; the table's rows, and with them what is broadcast, are bounded by it whatever the input.
SLOTS = 65_537
MOST_SLOTS = 4_000_037


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: dict[str, int], slots: int = SLOTS) -> list[str]:
    """The shard of each slot. shards: name to weight, a whole number from 1 (turns a round)."""
    if not _prime(slots) or slots > MOST_SLOTS:
        raise ValueError("slots must be a prime of at most MOST_SLOTS")
    if not shards or len(shards) > slots // 2 or any(w < 1 for w in shards.values()):
        raise ValueError("shards must be named, weigh 1 at least, and leave two slots each")
    names = sorted(shards)
    digests = [hashlib.md5(n.encode()).digest() for n in names]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    owner: list[int] = [-1] * slots
    free = slots
    while True:
        for k, name in enumerate(names):
            for _ in range(shards[name]):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + step[k]) % slots
                owner[at[k]] = k
                free -= 1
                if not free:
                    return [names[o] for o in owner]


def table_frame(spark, shards: dict[str, int], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows (slot, shard), one JSON literal unfolded, so that no Python runs on an executor."""
    names = sorted(shards)
    number = {n: k for k, n in enumerate(names)}
    codes = "[" + ",".join(str(number[n]) for n in lookup_table(shards, slots)) + "]"
    listed = spark.range(1).select(F.posexplode(F.from_json(F.lit(codes), "array<int>")).alias("slot", "code"))
    labels = F.array(*[F.lit(n) for n in names])
    return listed.select("slot", F.element_at(labels, F.col("code") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """From the first 60 bits of the key's MD5 (null as the empty text), which other engines compute alike."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, shards: dict[str, int], *, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """df with columns slot and shard (taken anew if df has such). No shuffle, so no key's share of the rows matters.

    A null key is placed like an empty one; equal keys go to one shard; an empty table stays empty; further columns of any
    name go along.
    """
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    at, owner = (f"{n}_{uuid.uuid4().hex}" for n in ("slot", "shard"))
    # SLOTS rows whatever the input, so the broadcast is bounded
    table = table_frame(df.sparkSession, shards, slots).select(F.col("slot").alias(at), F.col("shard").alias(owner))
    return placed.join(F.broadcast(table), F.col("slot") == F.col(at)).select(*placed.columns, F.col(owner).alias("shard"))


def shard_balance(placed: DataFrame) -> DataFrame:
    """Rows by shard; summed in each task before the shuffle."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"))


def write_shards(placed: DataFrame, path: str, *, files_a_shard: int = 8) -> None:
    """A folder a shard; rows of a shard are dealt to several tasks by a hash of the whole row, so no task gets it alone."""
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in placed.columns if c != "shard"]), F.lit(files_a_shard))
    placed.repartition(F.col("shard"), deal).write.partitionBy("shard").parquet(path)
