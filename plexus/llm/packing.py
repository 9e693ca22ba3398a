"""Best-fit packing into bins of several permitted capacities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty


def pack(sizes: Sequence[int], capacities: Sequence[int], bin_cost: float) -> tuple[list[int], list[int], list[int], float]:
    """(bin, offset) of each item, capacity of each bin, and their cost (capacity plus ``bin_cost`` each).

    Items come largest first (ties as given). An item goes to the open bin, of whatever capacity, with least room
    that it fits in. If none has room a bin is opened; how large is settled jointly: each permitted capacity is tried
    as the least one to open (an item that needs more opens the smallest that holds it), every trial ends with each
    bin cut down to the smallest capacity that holds its contents, and the cheapest trial stands.
    """
    caps = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    best = None
    for least in caps:
        rooms: dict[int, list[int]] = {}
        mask, fill = 0, []
        where, start = [0] * len(sizes), [0] * len(sizes)
        full: list[int] = []
        for i in order:
            size = sizes[i]
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                stack = rooms[room]
                b = stack.pop()
                if not stack:
                    mask ^= 1 << room
            else:
                room = next(c for c in caps if c >= max(size, least))
                b = len(fill)
                fill.append(0), full.append(room)
            where[i], start[i] = b, fill[b]
            fill[b] += size
            if left := room - size:
                stack = rooms.setdefault(left, [])
                if not stack:
                    mask |= 1 << left
                stack.append(b)
        ends = [caps[int(k)] for k in np.searchsorted(caps, fill)]
        cost = sum(ends) + bin_cost * len(ends)
        if best is None or cost < best[3]:
            best = where, start, ends, cost
    return best


def pack_documents(
    docs: DataFrame, capacities: Sequence[int] = (512, 1024, 2048, 4096, 8192), size: Column | None = None, bin_cost: float = 64.0, group_rows: int = 8192, key: str = "doc_id", seed: int = 11
) -> DataFrame:
    """(key, piece, start, size, bin, offset, capacity, filled): a row for each piece of each document.

    ``size`` is by default the number of words and one end mark. What exceeds the largest capacity is cut into pieces
    of that capacity and a last one of the rest; ``start`` is a piece's place in its document. Rows are dealt by a hash
    of the key and of the size into groups of about ``group_rows``, as many as the count of all rows asks for, and each
    group is packed for itself: so the same table gives the same bins on any cluster. Of rows equal in both, however
    many, and of the pieces of one document each run of ``group_rows`` is dealt for itself. Only keys and sizes are shuffled.

    Null and empty texts are of size 1. Null keys are packed like others; repeated rows have a place each. No rows give no bins. ``bin`` is unique over all groups: group, a dash, and a number.
    """
    caps = sorted({int(c) for c in capacities})
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    if size is None:
        size = F.regexp_count(text_or_empty(), F.lit(WORD)) + 1
    sized = docs.select(F.col(key), F.greatest(F.coalesce(size, F.lit(0)), F.lit(1)).cast("long").alias("_all"))
    groups = max(1, -(-docs.count() // group_rows))
    # Rows equal in key and size are one with a count until they are dealt: a group gets at most about ``group_rows`` pieces of them.
    alike = sized.groupBy(key, "_all").agg(F.count("*").alias("_n"))
    many = f"(_all - 1) div {caps[-1]} + 1"
    parts = alike.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_n * ({many}) - 1) div {group_rows})"))).repartition(key, "_all", "_part")
    pieces = parts.select(key, "_all", "_part", F.explode(F.expr(f"sequence(_part * {group_rows}, least(_n * ({many}), (_part + 1) * {group_rows}) - 1)")).alias("_i")).withColumn("_k", F.expr(f"_i % ({many})"))
    pieces = pieces.select(
        F.pmod(F.xxhash64(F.lit(seed), key, "_all", "_part"), F.lit(groups)).alias("_group"), key, F.col("_k").alias("piece"), (F.col("_k") * caps[-1]).alias("start"), F.least(F.lit(caps[-1]), F.col("_all") - F.col("_k") * caps[-1]).alias("size"),
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([key, "piece", "size"], kind="stable", ignore_index=True)
        where, start, ends, _ = pack(group["size"].tolist(), caps, bin_cost)
        used = np.bincount(where, weights=group["size"]).astype(np.int64)
        name = f"{group['_group'].iloc[0]}-"
        return group.drop(columns="_group").assign(bin=[name + str(b) for b in where], offset=np.array(start, np.int64), capacity=np.array(ends, np.int64)[where], filled=used[where])

    kind = docs.schema[key].dataType.simpleString()
    return pieces.groupBy("_group").applyInPandas(run, f"`{key}` {kind}, piece long, start long, size long, bin string, offset long, capacity long, filled long")
