"""Placement on shards through a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own: a start and
a step drawn from its name. Shards take turns claiming the first free slot they prefer,
so each owns an equal part, and a changed list of shards moves few slots. Rows find
their shard by the slot of their key's hash.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest table sent to all executors: 1 M slots of 12 bytes.
MAX_SLOTS = 1 << 20


def _drawn(name: str, purpose: str, below: int) -> int:
    digest = hashlib.blake2b(f"{purpose}:{name}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") % below


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def slot_table(shards: list[str], slots: int) -> list[int]:
    """Index of the shard that owns each slot."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be given, each once")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    at = [_drawn(name, "start", slots) for name in shards]
    step = [1 + _drawn(name, "step", slots - 1) for name in shards]
    owner = [-1] * slots
    for claim in range(slots):
        turn = claim % len(shards)
        while owner[at[turn]] >= 0:
            at[turn] = (at[turn] + step[turn]) % slots
        owner[at[turn]] = turn
    return owner


def placed(docs: DataFrame, shards: list[str], slots: int, key: Column, fallback: Column | None = None) -> DataFrame:
    """Add `slot` and `shard` to every row; columns of those names are replaced.

    Rows with equal keys share a shard. Rows with a null key go by `fallback`, and all
    to one slot where that is null too. The table has a fixed size and is broadcast,
    so placement costs no shuffle. No rows give no rows.
    """
    spark = docs.sparkSession
    owner = slot_table(shards, slots)
    names = pd.DataFrame({"slot": range(slots), "shard": [shards[i] for i in owner]})
    table = F.broadcast(spark.createDataFrame(names, "slot int, shard string"))
    hashed = F.xxhash64(key)
    if fallback is not None:
        hashed = F.when(key.isNull(), F.xxhash64(fallback)).otherwise(hashed)
    rows = docs.drop("slot", "shard").withColumn("slot", F.pmod(hashed, F.lit(slots)).cast("int"))
    columns = rows.columns
    return rows.join(table, "slot").select(*columns, "shard")
