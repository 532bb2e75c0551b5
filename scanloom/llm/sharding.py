"""Sharding by a permutation-filled lookup table.

Every shard walks its own permutation of a table of prime size; shards take turns
(as many a round as their weight) and claim the next free slot of their walk. The
table spreads keys evenly, and a change of shards moves few of them. It has a
fixed size, so broadcasting it has a known cost; placing a row is one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table (a prime): some hundreds for each shard, SLOTS_A_SHARD at least; 65,537 rows of two numbers are about 1 MB.
SLOTS = 65_537
MOST_SLOTS, SLOTS_A_SHARD = 1_000_003, 50


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}|{name}".encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """The shard (its place in ``shards``) of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not 1 < slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime up to {MOST_SLOTS}")
    if slots < SLOTS_A_SHARD * len(shards):
        raise ValueError(f"{len(shards)} shards need {SLOTS_A_SHARD * len(shards)} slots at least")
    first = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    at, table, free = list(first), [-1] * slots, slots
    while free:
        for k, n in enumerate(turns):
            for _ in range(n):
                if not free:
                    break
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                table[at[k]] = k
                free -= 1
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 15 hexadecimal digits of its MD5, modulo slots; a null key is hashed as no text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots))


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """The table as ``slot, shard``."""
    table = fill(shards, slots, weights)
    return spark.createDataFrame([(k, shards[s]) for k, s in enumerate(table)], "slot long, shard string")


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None, key: str = "doc_id") -> DataFrame:
    """docs with ``shard_slot, shard`` (replaced if there): a broadcast lookup, no shuffle.

    Rows keep their columns; null keys go to one fixed slot, repeated rows to the same.
    """
    table = lookup(docs.sparkSession, shards, slots, weights).toDF("shard_slot", "shard")
    rest = docs.drop("shard_slot", "shard")
    return rest.withColumn("shard_slot", slot(rest[key], slots)).join(F.broadcast(table), "shard_slot").select(*rest.columns, "shard_slot", "shard")


def write_shards(placed: DataFrame, path: str, parts: int = 4, key: str = "doc_id") -> None:
    """Parquet below path, one folder a shard, dealt over ``parts`` tasks each by a hash of the key."""
    salt = F.pmod(F.xxhash64(key), F.lit(parts))
    placed.repartition("shard", salt).write.mode("overwrite").partitionBy("shard").parquet(path)
