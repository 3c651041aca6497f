"""Placement by a permutation-filled lookup table, in DataFrame functions only.

Every shard has its own order of the slots of a table of prime size (an offset and a step from its name). Shards take turns:
each claims the first slot of its order that is still free, until all slots are taken. A key's hash picks a slot, and the slot
its shard, in constant time. Shares differ by at most one slot, and a shard more or less moves little beyond its own share.

The table depends on shard names only; its size is a parameter, so what every task holds is bounded. Null keys count as the
empty text. Repeated keys go to the same shard. No shards is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 16_381  # prime


def _number(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode(), usedforsecurity=False).hexdigest()[:15], 16)


def lookup(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard at each slot. Duplicate names are refused."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be one or more different names, at most one for each slot")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    taken = 0
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            taken += 1
            if taken == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots


def place(docs: DataFrame, key: str, shards: list[str], slots: int = SLOTS, name: str = "shard") -> DataFrame:
    """``docs`` with ``slot`` and the shard of ``key`` as ``name``; columns of these names are replaced. No shuffle."""
    table = ",".join(map(str, lookup(shards, slots)))
    # One row of `slots` numbers: the bound of what is broadcast.
    one = docs.sparkSession.sql("select 1").select(F.split(F.lit(table), ",").cast("array<int>").alias("_table"), F.array(*map(F.lit, shards)).alias("_names"))
    rest = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in ("slot", name)], slot_of(docs[f"`{key}`"], slots).alias("slot"))
    joined = rest.join(F.broadcast(one), F.lit(True))
    return joined.withColumn(name, F.get("_names", F.get("_table", F.col("slot").cast("int")))).drop("_table", "_names")


def write(docs: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS, files: int = 1) -> None:
    """Parquet by shard, each cut into ``files`` parts so that a large shard spreads over tasks."""
    placed = place(docs, key, shards, slots)
    placed.repartition(F.col("shard"), F.pmod(F.xxhash64(key), F.lit(files))).write.mode("overwrite").partitionBy("shard").parquet(path)
