"""Quality by naive Bayes support vectors: n-gram indicators scaled by log-count ratios under a hinge loss."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, labelled_sample, text_or_empty

_PIECES = re.compile(r"\w+|[^\w\s]+").findall


class _Shapes(dict):
    """The shape of a piece: how its letters are cased, a digit's, or the marks themselves."""

    def __missing__(self, piece: str) -> str:
        if len(self) > 300_000:
            self.clear()
        head = piece[0]
        if head.isalpha():
            shape = "A" if len(piece) > 1 and piece.isupper() else "T" if head.isupper() else "w"
        else:
            shape = "0" if head.isalnum() else piece
        self[piece] = shape
        return shape


_SHAPES = _Shapes()
_AGAIN = "="


def grams(text: str) -> set:
    """The n-grams of a whole text: pieces, pairs of pieces, pairs of their shapes, and pairs of lines, new or seen before.

    A piece that is the one before it has the shape of a repetition, so pairs of shapes tell how a text repeats itself.
    """
    pieces = _PIECES(text)
    found: set = set(pieces)
    found.update(zip(pieces, pieces[1:], strict=False))
    shapes = [_AGAIN if a == b else s for a, b, s in zip(pieces, [None, *pieces], map(_SHAPES.__getitem__, pieces), strict=False)]
    found.update(("shapes", a, b) for a, b in set(zip(shapes, shapes[1:], strict=False)))
    seen: set = set()
    lines = [line in seen or seen.add(line) is not None for line in text.split("\n")]
    found.update(("lines", a, b) for a, b in set(zip(lines, lines[1:], strict=False)))
    return found


class Classifier:
    """index: place of an n-gram; scaled: its weight times its log-count ratio; ratio: that ratio; slope: of the logistic curve."""

    def __init__(self, index: dict, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float):
        self.index, self.ratio, self.weight, self.bias, self.slope = index, ratio, weight, bias, slope

    def margin(self, text: str) -> float:
        get = self.index.get
        at = np.fromiter((i for g in grams(text) if (i := get(g)) is not None), np.int64)
        if not len(at):
            return self.bias
        value = self.ratio[at]
        return float(self.weight[at] @ value) / max(1.0, math.sqrt(value @ value)) + self.bias

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * self.margin(text)))))


def fit(sample: list[tuple[str, int]], max_grams: int = 1 << 16, least: int = 3, cost: float = 1.0, passes: int = 30, seed: int = 0) -> Classifier:
    """Dual coordinate descent over the sample; n-grams of fewer than ``least`` texts are left out.

    A sample without both labels gives the constant that fits it: 1, 0, or 0.5 of an empty one.
    """
    sides = [sum(1 for _, y in sample if y == k) for k in (0, 1)]
    if not all(sides):
        return Classifier({}, np.zeros(0), np.zeros(0), float(np.sign(sides[1] - sides[0])) * 40, 1.0)
    # Most n-grams stand in one text only. Counts by hash leave these out before any are held; what is kept is counted exactly.
    mask = (1 << 22) - 1
    slots = np.zeros(mask + 1, np.uint16)
    for t, _ in sample:
        some = np.unique(np.fromiter((hash(g) & mask for g in grams(t)), np.int64))
        slots[some] += slots[some] < least
    good, bad = Counter(), Counter()
    for t, y in sample:
        (good if y else bad).update(g for g in grams(t) if slots[hash(g) & mask] >= least)
    kept = sorted((g for g in good.keys() | bad.keys() if good[g] + bad[g] >= least), key=lambda g: (-good[g] - bad[g], str(g)))[:max_grams]
    index = {g: i for i, g in enumerate(kept)}
    p, q = (np.array([c[g] + 1.0 for g in kept]) for c in (good, bad))
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    at = [np.array(sorted(i for g in grams(t) if (i := index.get(g)) is not None), np.int64) for t, _ in sample]
    value = [ratio[i] / max(1.0, math.sqrt(ratio[i] @ ratio[i])) for i in at]
    sign = [1.0 if y else -1.0 for _, y in sample]
    weight, bias, alpha = np.zeros(len(kept)), 0.0, np.zeros(len(sample))
    norm = [float(v @ v) + 1 for v in value]
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(sample)):
            slope = sign[i] * (weight[at[i]] @ value[i] + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost)
            if step := (new - alpha[i]) * sign[i]:
                weight[at[i]] += step * value[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    margins = np.array([s * (weight[i] @ v + bias) for s, i, v in zip(sign, at, value, strict=True)])
    steps = np.arange(1, 41) / 4
    slope = float(steps[np.argmin([np.logaddexp(0, -k * margins).mean() + 1e-3 * k for k in steps])])
    return Classifier(index, ratio, weight, bias, slope)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = 4000, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) with held_out, score in 0..1 and predicted (1: good) of every row, from its text alone.

    Learns on the driver from at most ``max_labelled`` labelled rows that are not held out; scores need no shuffle.
    Null texts count as empty and have a score too; null ids and repeated rows keep their rows; a null label is no label.
    """
    model = fit(labelled_sample(docs, labels, "quality", max_labelled))
    return scored(docs, model.score, threshold, ["doc_id"] if keep is None else keep)


def scored(docs: DataFrame, score, threshold: float, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, held_out, score(text) and predicted; ``score`` runs in Arrow batches on the executors.

    Kept columns ride in a struct, so their names clash with nothing; those named like the new ones are replaced.
    """
    kept = F.struct(*[c for c in keep if c not in ("held_out", "score", "predicted")])
    rows = docs.select(kept.alias("kept"), is_held_out().alias("held_out"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([score(t.as_py()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["kept", "held_out", "score"])

    schema = rows.drop("text").schema.add("score", "double")
    return rows.mapInArrow(run, schema).select("kept.*", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
