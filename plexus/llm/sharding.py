"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table goes to every executor; so its size is bounded.
MOST_SLOTS = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int) -> list[int]:
    """The number of the shard that has each slot.

    A shard prefers the slots in the order offset, offset + skip, offset + 2 skip, ... modulo the prime number of slots,
    offset and skip being digests of its name. Shards take turns; each claims its next preferred slot that is free.
    """
    if not 1 <= len(shards) <= slots <= MOST_SLOTS or len({*shards}) < len(shards):
        raise ValueError(f"shards must be distinct, and slots between their number and {MOST_SLOTS}")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_number(f"offset|{s}") % slots for s in shards]
    skip = [_number(f"skip|{s}") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def lookup(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """(slot, shard): the filled table, made of one packed string."""
    packed = F.lit("".join(f"{i:07d}" for i in fill(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(slots, numPartitions=1).select(F.col("id").alias("slot"), F.get(names, F.substr(packed, F.col("id").cast("int") * 7 + 1, F.lit(7)).cast("int")).alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = 8191, spread: Sequence[str] = ()) -> DataFrame:
    """The rows with slot and shard: a digest of the key picks a slot of the broadcast table, in constant time and without a shuffle.

    ``spread`` names columns that part the rows of one key (a key with a third of all rows): they join the digest.
    Null keys count as the empty text; equal keys (and spread values) go together; no rows give no rows. Columns
    named slot or shard are replaced. A shard more or less moves few slots besides its own.
    """
    whole = F.col(key) if not spread else F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *spread)])
    return rows.drop("slot", "shard").withColumn("slot", slot_of(whole, slots)).join(F.broadcast(lookup(rows.sparkSession, shards, slots)), "slot")


OP1_SQL = r"""
WITH RECURSIVE shard AS (SELECT i, printf('shard-%02d', i) AS name FROM range(64) t(i)),
pref AS (SELECT list(('0x' || substr(md5('offset|' || name), 1, 15))::BIGINT % 8191 ORDER BY i) AS off,
                list(('0x' || substr(md5('skip|' || name), 1, 15))::BIGINT % 8190 + 1 ORDER BY i) AS skip FROM shard),
turn(n, slot, taken, nxt) AS (
  SELECT 0::BIGINT, -1::BIGINT, list_transform(range(8191), lambda x: false), list_transform(range(64), lambda x: 0::BIGINT)
  UNION ALL
  SELECT n + 1, s, list_concat(list_concat(taken[1:s], [true]), taken[s + 2:]), list_concat(list_concat(nxt[1:i], [j + 1]), nxt[i + 2:])
  FROM (SELECT *, (off[i + 1] + j * skip[i + 1]) % 8191 AS s
        FROM (SELECT *, list_filter(range(nxt[i + 1], 8191), lambda x: NOT taken[(off[i + 1] + x * skip[i + 1]) % 8191 + 1])[1] AS j
              FROM (SELECT turn.*, n % 64 AS i, pref.* FROM turn, pref WHERE n < 8191))))
SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 8191 AS slot, printf('shard-%02d', (n - 1) % 64) AS shard
FROM documents JOIN turn ON turn.slot = ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 8191
"""
