"""Near-duplicate vectors by cosine: rotated blocks, a range join in each, exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components, forest


def rotation(dim: int, seed: int) -> np.ndarray:
    """A seeded orthogonal matrix: it spreads what a few coordinates hold over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows at length one; the first division keeps squares from overflowing."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def turn(unit: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rotated vectors. Not by BLAS: a vector must come out the same to the last bit in every task."""
    return np.einsum("ij,kj->ik", unit, rows, optimize=False)


def blocks_of(dim: int, size: int) -> list[slice]:
    edges = np.linspace(0, dim, max(1, dim // size) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


class _Cells:
    """Cells of one block: a grid over its first coordinates, each at least as wide as the block's reach.

    Two vectors within reach are in the same or in adjacent cells. So a vector is a resident of its own cell and
    asks in the cells that its ball of that radius touches, but for those before its own.
    """

    def __init__(self, reach: float, axes: int):
        self.reach, self.axes = reach, axes

    def deal(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = y[:, : self.axes]
        own = np.floor(y / self.reach).astype(np.int64)
        code = self._code(own)
        index, cell, home = [np.arange(len(y))], [code], [np.ones(len(y), bool)]
        for step in np.ndindex(*(3,) * self.axes):
            step = np.array(step) - 1
            if not step.any():
                continue
            other = own + step
            low, high = other * self.reach, (other + 1) * self.reach
            gap = np.maximum(np.maximum(low - y, y - high), 0)
            go = ((gap**2).sum(1) <= self.reach**2) & ((there := self._code(other)) > code)
            index.append(np.nonzero(go)[0]), cell.append(there[go]), home.append(np.zeros(go.sum(), bool))
        return np.concatenate(index), np.concatenate(cell), np.concatenate(home)

    def _code(self, cells: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cells), np.int64)
        for i in range(cells.shape[1]):
            out = out * 4096 + cells[:, i] + 2048
        return out


def near_vectors(
    vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", block: int = 16, axes: int = 2, tile: int = 8192, seed: int = 7
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: links are pairs of rows with cosine >= ``least`` (double precision).

    Vectors are scaled to length one and rotated. If two have cosine >= c, the squared distance of d = 2 - 2c is shared
    out among the blocks, and in one block at least they are no further apart than that block's share by its width.
    Each block is range-joined over cells; what passes there is checked exactly on the whole vectors. A pair counts in
    the first block that admits it, so it's counted once; what leaves a task is a count for each vector and spanning
    stars of the links, never the pairs. Cells of over ``tile`` rows are split in tiles, and pairs of tiles are dealt out.
    Equal vectors are one class, whatever its size.

    Null, zero or non-finite vectors, empty ones and those of null or non-finite components link with nothing (n_links 0,
    component their own key). Only vectors of equal length are compared. Rows of a null key link, but name no
    component. Rows of one key but different vectors keep a row each.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    fit = F.expr("_v is not null and size(_v) > 0 and forall(_v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(_v, x -> x <> 0)")
    rows = rows.withColumn("_v", F.when(fit, F.expr("transform(_v, x -> x + 0.0D)")))
    # Equal vectors are found by 128 bits of hashes, so that no vector is a key; a class that holds two vectors is an error.
    rows = rows.withColumn("_h", F.xxhash64("_v")).withColumn("_g", F.xxhash64(F.lit(seed), "_v"))
    alike = F.when(F.min("_v") == F.max("_v"), F.min("_v")).otherwise(F.raise_error(F.lit("different vectors have the same hashes")))
    classes = staged(rows.where("_v is not null").groupBy("_h", "_g").agg(alike.alias("_v"), F.min("_id").alias("first"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    budget, element = 2 - 2 * least, vectors.schema[vector].dataType.elementType.simpleString()
    element = element if element == "float" else "double"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations: dict[int, np.ndarray] = {}
        for batch in batches:
            rep, n, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.asarray(pc.list_value_length(lists))
            for dim in map(int, np.unique(sizes)):
                pick = np.nonzero(sizes == dim)[0]
                raw = np.asarray(lists.take(pa.array(pick)).flatten(), np.float64).reshape(-1, dim)
                if dim not in rotations:
                    rotations[dim] = rotation(dim, seed)
                turned = turn(scaled(raw), rotations[dim])
                for b, part in enumerate(blocks_of(dim, block)):
                    reach = np.sqrt(budget * (part.stop - part.start) / dim) * (1 + 1e-9) + 1e-9
                    index, cell, home = _Cells(reach, min(axes, part.stop - part.start)).deal(turned[:, part])
                    of = pick[index]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(of), x, np.int32)) for x in (dim, b)] + [pa.array(cell), pa.array(home), pa.array(rep[of]), pa.array(n[of]), lists.take(pa.array(of))],
                        ["dim", "block", "cell", "home", "rep", "n", "v"],
                    )

    shape = f"dim int, block int, cell long, home boolean, rep long, n long, v array<{element}>"
    dealt = staged(classes.select("rep", "n", F.col("_v").cast(f"array<{element}>").alias("v")).mapInArrow(spread, shape), "cells")
    place = ["dim", "block", "cell"]
    # Residents and askers of a cell are cut by a hash; each pair of cuts is a tile, and a task's worth of its own.
    sizes = dealt.groupBy(*place).agg(F.ceil(F.count_if("home") / tile).cast("int").alias("own"), F.ceil(F.count("*") / tile).cast("int").alias("ask"))
    cut = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    sized = dealt.join(sizes.where("own > 0"), place)
    rest = ["home", "rep", "n", "v"]
    owners = sized.where("home").select(*place, cut("own").alias("i"), F.explode(F.expr("sequence(0, ask - 1)")).alias("j"), F.lit(True).alias("owns"), *rest)
    askers = sized.select(*place, F.explode(F.expr("sequence(0, own - 1)")).alias("i"), cut("ask").alias("j"), F.lit(False).alias("owns"), *rest)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        dim, b = int(group["dim"].iloc[0]), int(group["block"].iloc[0])
        owns, home = group["owns"].to_numpy(bool), group["home"].to_numpy(bool)
        rep, n = group["rep"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        unit = scaled(np.vstack(group["v"].to_numpy()).astype(np.float64))
        turned, parts = turn(unit, rotation(dim, seed)), blocks_of(dim, block)
        share = [budget * (p.stop - p.start) / dim + 1e-9 for p in parts]
        own, ask, p = np.nonzero(owns)[0], np.nonzero(~owns)[0], parts[b]
        own_part, square = turned[own, p].astype(np.float32), (turned[own, p] ** 2).sum(1).astype(np.float32)
        count, left, right, held = np.zeros(len(group), np.int64), [rep[:0]], [rep[:0]], 0
        for s in range(0, len(ask), 512):
            a = ask[s : s + 512]
            # |x - y|^2 <= share, in single precision and with room for its error: a superset.
            near = turned[a, p].astype(np.float32) @ own_part.T
            near -= square[None, :] / 2
            x, y = np.nonzero(near >= ((turned[a, p] ** 2).sum(1) / 2 - share[b] / 2 - 1e-5).astype(np.float32)[:, None])
            for t in range(0, len(x), 1 << 16):
                i, j = a[x[t : t + (1 << 16)]], own[y[t : t + (1 << 16)]]
                # Two residents meet twice, once from each side.
                keep = ~home[i] & (rep[i] != rep[j]) | (rep[i] < rep[j])
                i, j = i[keep], j[keep]
                keep = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
                i, j = i[keep], j[keep]
                for k, q in enumerate(parts[: b + 1]):
                    inside = ((turned[i, q] - turned[j, q]) ** 2).sum(1) <= share[k]
                    keep = inside if k == b else ~inside
                    i, j = i[keep], j[keep]
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                left.append(rep[i]), right.append(rep[j])
                if (held := held + len(i)) > 1 << 20:
                    u, w = forest(np.concatenate(left), np.concatenate(right))
                    left, right, held = [u], [w], 0
        u, w = forest(np.concatenate(left), np.concatenate(right))
        at = np.nonzero(count)[0]
        return pd.DataFrame({"a": np.concatenate([rep[at], u]), "b": pd.array(np.concatenate([rep[at], w]), "Int64"), "n": np.concatenate([count[at], np.zeros(len(u), np.int64)])})

    found = staged(owners.unionByName(askers).groupBy(*place, "i", "j").applyInPandas(join, "a long, b long, n long"), "found")
    counts = found.groupBy("a").agg(F.sum("n").alias("others"))
    linked = components(found.where("a <> b"))
    named = (
        classes.select("_h", "_g", "rep", "n", "first")
        .join(counts, classes.rep == counts.a, "left")
        .join(linked, F.col("rep") == linked.node, "left")
        .select("_h", "_g", "n", "first", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "rep").alias("component"))
    )
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_vector = named.join(lowest, "component").select("_h", "_g", (F.col("others") + F.col("n") - 1).alias("n_links"), "component_id")
    # Vectors that link with nothing stand for themselves; joined by key they would all meet in one task.
    good = rows.where("_v is not null").select("_id", "_h", "_g").join(by_vector, ["_h", "_g"]).select("_id", "n_links", "component_id")
    lone = rows.where("_v is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return good.unionByName(lone).select(F.col("_id").alias(key), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))
