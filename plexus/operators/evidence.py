"""What of gaps, branches and captures counts in a review's scope: whole files, nodes, and spans of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .intervals import touched

# Reasons in the order in which records stand.
REASONS = ("parser-error", "parser-no-tree", "missing", "ambiguous", "dynamic-or-unsupported-dispatch", "oversized", "binary")


def relevant(gaps: DataFrame, key: str, files: DataFrame, nodes: DataFrame, spans: DataFrame, by: str = "file_id", owner: str = "source_id") -> DataFrame:
    """gaps (key, by, owner, line_start, line_end) of a file that is in scope as a whole, of a node in scope, or whose lines a span in
    scope overlaps, each once. A gap without lines counts by its file or owner alone."""
    whole = gaps.join(files.select(by).distinct(), by, "left_semi")
    owned = gaps.join(nodes.select(F.col("id").alias(owner)).distinct(), owner, "left_semi")
    lines = touched(spans, gaps.where("line_start is not null"), by)
    return whole.unionByName(owned.select(*gaps.columns)).unionByName(lines.select(*gaps.columns)).dropDuplicates([key])


def relevant_branches(branches: DataFrame, key: str, spans: DataFrame, by: str = "file_id") -> DataFrame:
    """branches (key, by, line_start, line_end, arc) in scope: an arc by the line that it leaves or the one it goes to, others by their range."""
    ends = branches.where("arc").withColumn("_at", F.explode(F.array("line_start", "line_end")))
    ends = ends.withColumns({"line_start": F.col("_at"), "line_end": F.col("_at")}).drop("_at")
    hit = touched(spans, ends.unionByName(branches.where("not arc")), by).select(key).distinct()
    return branches.join(hit, key, "left_semi")


def static_gap_records(gaps: DataFrame, unresolved: DataFrame) -> DataFrame:
    """path, line_start, line_end, reason, occurrences, order of gaps and of dependencies that resolve to nothing; like ones are one.

    ``order`` sorts reasons as REASONS stands; sort by (order, path, line_start, line_end).
    """
    both = gaps.select("path", "line_start", "line_end", "reason").unionByName(unresolved.select("path", "line_start", "line_end", "reason"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason")), F.lit(0).cast("long")), F.lit(len(REASONS) + 1).cast("long"))
    return both.groupBy("path", "line_start", "line_end", "reason").agg(F.count("*").alias("occurrences")).withColumn("order", place)


def status_counts(entries: DataFrame, by: str) -> DataFrame:
    """by, staged, unstaged, untracked: distinct paths of each layer."""
    paths = lambda layer: F.count_distinct(F.when(F.col("layer") == layer, F.col("path"))).alias(layer)
    return entries.groupBy(by).agg(paths("staged"), paths("unstaged"), paths("untracked"))


def dirty_digest(entries: DataFrame, by: str) -> DataFrame:
    """by, digest of a work tree's state (layer, path, status, content_key): the same whatever order rows come in, another if any of them differs."""
    row = S.framed_hash(F.col("layer"), F.col("path"), F.col("status"), F.col("content_key"))
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return entries.groupBy(by).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), half(1), half(16), half(31)), 256).alias("digest"))
