"""SimHash near-duplicates: fingerprints, a vantage-point tree over them, exact pairs from its shards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged, text_or_empty
from .components import components, forest

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
#: For each byte value its eight bits, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Shingles that are hashed at once.
_CHUNK = 1 << 20


def fingerprint(text: str, width: int) -> int:
    """64 bits: each is set if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles."""
    words = _WORDS(text.translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    tally, digest = np.zeros((8, 8), np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + width - 1]
        shingles = [" ".join(part)] if len(words) <= width else map(" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
        octets = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
        tally += np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(tally.ravel() * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as a signed long). Null and empty texts have fingerprint zero; whole texts, A-Z lowered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, fingerprint long")


def _apart(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Node:
    """``far`` holds what is over ``radius`` away from ``point``, ``near`` the rest; a leaf has its number instead."""

    point: int = 0
    radius: int = 0
    near: Node | None = None
    far: Node | None = None
    leaf: int = -1


def grow(sample: np.ndarray, leaves: int, reach: int, rng: np.random.Generator) -> Node:
    """A tree of about ``leaves`` shards. The sample settles its shape only: any tree gives the exact pairs.

    Of some points and radii the one is taken under which fewest of the sample lie within ``reach`` of the border,
    among those that leave a quarter on the smaller side (a tie-ridden sample may not part so: then it's a leaf).
    """
    numbers = iter(range(1 << 30))

    def part(points: np.ndarray, want: int) -> Node:
        best, chosen = None, None
        if want > 1 and len(points) >= 8:
            for point in rng.choice(points, min(24, len(points)), replace=False):
                away = _apart(points, point)
                for radius in np.unique(np.quantile(away, (0.3, 0.4, 0.5, 0.6, 0.7)).astype(int)):
                    near = (away <= radius).mean()
                    if 0.25 <= near <= 0.75:
                        cost = ((away > radius - reach) & (away <= radius + reach)).mean() + abs(near - 0.5)
                        if best is None or cost < best:
                            best, chosen = cost, (int(point), int(radius), away <= radius)
        if chosen is None:
            return Node(leaf=next(numbers))
        point, radius, near = chosen
        return Node(point, radius, part(points[near], want // 2), part(points[~near], want - want // 2))

    return part(sample, leaves)


def deal(tree: Node, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of a point, shard, whether it is at home there), one row for each shard that may hold a point within reach.

    By the triangle inequality what is within ``reach`` of a point can't lie beyond a border that is further away.
    A pair of two shards is left to the later one, so a point visits no shard before its home.
    """
    index, shard, home = [], [], []

    def down(node: Node, at: np.ndarray, mine: np.ndarray) -> None:
        if not len(at):
            return
        if node.leaf >= 0:
            index.append(at), shard.append(np.full(len(at), node.leaf)), home.append(mine)
            return
        away = _apart(points[at], np.uint64(node.point)).astype(np.int64)
        near = away <= node.radius
        go = near | (away - reach <= node.radius)
        down(node.near, at[go], (mine & near)[go])
        go = ~near | (away + reach > node.radius)
        down(node.far, at[go], (mine & ~near)[go])

    down(tree, np.arange(len(points)), np.ones(len(points), bool))
    index, shard, home = map(np.concatenate, (index, shard, home))
    of = np.zeros(len(points), np.int64)
    of[index[home]] = shard[home]
    keep = shard >= of[index]
    return index[keep], shard[keep], home[keep]


def within(points: np.ndarray, residents: np.ndarray, visitors: np.ndarray, reach: int, rng: np.random.Generator, small: int = 96) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (visitor, resident) of ``points`` at most ``reach`` apart, in parts, by a local tree; a point meets itself, too."""
    stack = [(residents, visitors)]
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        parted = False
        if len(own) > small:
            for _ in range(4):
                point = points[own[rng.integers(len(own))]]
                away = _apart(points[own], point).astype(np.int64)
                radius = int(np.median(away))
                near = away <= radius
                if 0 < near.sum() < len(own):
                    asked = _apart(points[ask], point).astype(np.int64)
                    stack += [(own[near], ask[asked - reach <= radius]), (own[~near], ask[asked + reach > radius])]
                    parted = True
                    break
        if parted:
            continue
        step = max(1, (1 << 19) // len(own))
        for at in range(0, len(ask), step):
            i, j = np.nonzero(_apart(points[ask[at : at + step], None], points[own][None, :]) <= reach)
            yield ask[at : at + step][i], own[j]


def close(residents: np.ndarray, visitors: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the pairs (visitor, resident) at most ``reach`` apart; links are folded as they come."""
    points, left, right, held = np.concatenate([residents, visitors]), [residents[:0]], [residents[:0]], 0
    for i, j in within(points, np.arange(len(residents)), np.arange(len(residents), len(points)), reach, rng):
        a, b = points[i], points[j]
        keep = a != b
        left.append(a[keep]), right.append(b[keep])
        held += int(keep.sum())
        if held > 1 << 20:
            a, b = forest(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], len(a)
    return forest(np.concatenate(left), np.concatenate(right))


def near_links(prints: DataFrame, reach: int = 3, shard_rows: int = 4096, sample_rows: int = 20_000, seed: int = 1) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect just what pairs at most ``reach`` bits apart connect.

    ``prints``: a table of distinct longs. A tree grown on up to ``sample_rows`` of them (picked by hash; it decides
    balance, not results) deals each to the shard that holds it and to those that its neighbours may be in.
    Each shard gives spanning stars, so the result is as long as its rows, however many pairs a group has.
    """
    spark = prints.sparkSession
    total = prints.count()
    sample = prints.orderBy(F.xxhash64(F.lit(seed), "fingerprint")).limit(sample_rows).toPandas()["fingerprint"].to_numpy(np.int64).view(np.uint64)
    tree = grow(sample, max(2 * partitions(spark), total // shard_rows), reach, np.random.default_rng(seed))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                points = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
                index, shard, home = deal(tree, points, reach)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, points[index].view(np.int64), home)], ["shard", "fingerprint", "home"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        points, home = group["fingerprint"].to_numpy(np.int64).view(np.uint64), group["home"].to_numpy(bool)
        a, b = close(points[home], points, reach, np.random.default_rng(seed))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return prints.mapInArrow(spread, "shard long, fingerprint long, home boolean").groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, reach: int = 3, key: str = "doc_id", text: str = "text", **tree) -> DataFrame:
    """(key, fingerprint long, component_id): component_id is the smallest key reachable by links of at most ``reach`` bits.

    Equal fingerprints are one class from the start, its size doesn't matter. Null and empty texts have fingerprint
    zero and link like any other. Rows with a null key keep their fingerprint, take part in links and have the
    component of their class (null if no row of it has a key); repeated rows give a row each.
    """
    prints = staged(fingerprints(docs, width, key, text), "fingerprints")
    classes = staged(prints.groupBy("fingerprint").agg(F.min(key).alias("first")), "classes")
    found = components(near_links(classes.select("fingerprint"), reach, **tree))
    # A component goes by a fingerprint up to here; its smallest key is wanted.
    named = classes.join(found, classes.fingerprint == found.node, "left").withColumn("component", F.coalesce("component", "fingerprint"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = named.select("fingerprint", "component").join(lowest, "component").select("fingerprint", "component_id")
    return prints.join(by_class, "fingerprint").select(key, "fingerprint", "component_id")
