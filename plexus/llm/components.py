"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import staged

#: Links that a file of a round holds, two longs each.
LINKS_A_FILE = 1 << 20


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links given: each end with the smallest end that it reaches within them.

    Whole arrays at once: minima travel along links, and labels jump to their labels' labels.
    """
    if not len(left):
        return left, right
    ends, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(ends))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jump := new[new]).tolist() != new.tolist():
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(ends))
    return ends[far], ends[label[far]]


def components(links: DataFrame, src: str = "a", dst: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link, component being the smallest node reachable.

    Alternates the large-star and the small-star step, each one aggregate with map-side minima and one
    equi-join, until the links no longer change; the rounds grow with the logarithm of the longest path.
    Every round is a table in the shared folder, in as many files as its links fill, but a file for each core at
    least, whatever the number of shuffle partitions: a round of few links is not hundreds of tiny files.
    Links to itself and null ends are left out; repeated links are harmless; no links give an empty result.
    """
    edges = staged(
        links.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct(),
        "links",
    )
    files = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // LINKS_A_FILE))
    mark = None
    # A round's own write tells how many links it has and a sum of their hashes: no job of its own for that.
    told = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        edges = staged(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct().observe(seen, *told), "links", files)
        now = seen.get
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
