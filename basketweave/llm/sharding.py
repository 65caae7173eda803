"""Constant-time shard placement by a lookup table that the shards fill in turns."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime, well above 100 slots for each shard; also the bound of the broadcast.
SLOTS = 65_537
SHARDS = 64


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it.

    Shard i prefers the slots ``offset + j * skip (mod slots)``; as ``slots`` is prime this visits every
    slot once. The shards take turns, each claiming the first free slot of its order, so their shares
    differ by one slot at most, and adding or removing a shard moves few other slots. The table depends on
    the shard names alone and has a fixed size, so it is filled on the driver.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most one per slot")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    at = [zlib.crc32(f"offset:{s}".encode()) % slots for s in shards]
    skip = [zlib.crc32(f"skip:{s}".encode()) % (slots - 1) + 1 for s in shards]
    owner, claimed = [-1] * slots, 0
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            claimed += 1
            if claimed == slots:
                return owner


def slot_of(key: str | Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the table size; a null key counts as ''."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str = "doc_id", shards: list[str] | int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` (index); replaces columns of these names.

    The table is broadcast: ``slots`` rows, whatever the input. Rows are neither moved nor grouped, so a key
    that holds a third of them costs no more than others.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else shards
    listed = ",".join(map(str, fill_table(names, slots)))
    lookup = rows.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("__slot", "__shard"))
    lookup = lookup.select(F.col("__slot").cast("long").alias("__slot"), F.col("__shard").cast("int").alias("__shard"))
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    keyed = rows.select(*kept, slot_of(key, slots).alias("slot"))
    return keyed.join(F.broadcast(lookup), F.col("slot") == F.col("__slot")).select(*kept, "slot", F.col("__shard").alias("shard"))


SHARD_SQL = """
WITH t AS (SELECT unnest(range({slots})) AS slot, unnest([{owners}]) AS shard),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots} AS slot FROM documents)
SELECT doc_id, slot, shard::INT AS shard FROM d JOIN t USING (slot)
"""


def shard_sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    owners = ",".join(map(str, fill_table([f"shard-{i}" for i in range(shards)], slots)))
    return SHARD_SQL.format(slots=slots, owners=owners)
