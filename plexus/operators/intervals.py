"""Line spans: overlap joins, merging, what is left uncovered, and fixpoints of scope.

Spans are closed and in doubled coordinates: line n is 2n, the gap after it 2n + 1 (where a deletion stands).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def overlap(left: DataFrame, right: DataFrame, on: str, left_span=("start", "end"), right_span=("line_start", "line_end"), width: int = 128) -> DataFrame:
    """Pairs of rows of one ``on`` value whose spans overlap. Both are dealt to blocks of ``width``, so the join is by
    equal (on, block); a pair counts in the first block that it shares."""
    (a, b), (c, d) = left_span, right_span
    block = lambda df, x, y: df.withColumn("_block", F.explode(F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width))))
    joined = block(left, a, b).join(block(right, c, d), [on, "_block"])
    return joined.where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("_block") == F.floor(F.greatest(a, c) / width))).drop("_block")


def merged(spans: DataFrame, by: str) -> DataFrame:
    """by, start, end: spans of one ``by`` joined where they overlap or touch (islands over a running maximum).

    Spans of one start are one before they meet, so a file's window has a row a start at most, however often it was touched.
    """
    spans = spans.groupBy(by, "start").agg(F.max("end").alias("end"))
    line = Window.partitionBy(by).orderBy("start", "end")
    top = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(top.isNull() | (F.col("start") > top + 1), 1).otherwise(0))
    return marked.withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0))).groupBy(by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def residual(changes: DataFrame, coverage: DataFrame, by: str) -> DataFrame:
    """by, start, end of what changed spans keep outside coverage; odd edges go inward, single anchors stay as they are."""
    changed, covered = merged(changes, by), merged(coverage, by).select(by, F.col("start").alias("line_start"), F.col("end").alias("line_end"))
    hit = overlap(changed, covered, by).select(by, "start", "end", "line_start", "line_end")
    line = Window.partitionBy(by, "start", "end").orderBy("line_start")
    before = hit.withColumn("_from", F.coalesce(F.lag("line_end").over(line) + 1, F.col("start"))).select(by, F.col("_from").alias("a"), (F.col("line_start") - 1).alias("b"))
    after = hit.groupBy(by, "start", "end").agg(F.max("line_end").alias("_to")).select(by, (F.col("_to") + 1).alias("a"), F.col("end").alias("b"))
    whole = changed.join(hit.select(by, "start", "end").distinct(), [by, "start", "end"], "left_anti").select(by, F.col("start").alias("a"), F.col("end").alias("b"))
    left = before.unionByName(after).unionByName(whole).where("a <= b")
    anchor = F.col("a") == F.col("b")
    rounded = left.select(by, F.when(anchor, F.col("a")).otherwise(F.col("a") + F.col("a") % 2).alias("start"), F.when(anchor, F.col("b")).otherwise(F.col("b") - F.col("b") % 2).alias("end"))
    return rounded.where("start <= end")


def touched(changes: DataFrame, symbols: DataFrame, by: str) -> DataFrame:
    """Symbols (line_start, line_end) that a changed span (start, end) overlaps. Spans are merged first, so no pairs pile up."""
    return overlap(merged(changes, by), symbols, by).select(*symbols.columns)


def in_scope(notes: DataFrame, changes: DataFrame, symbols: DataFrame, by: str) -> DataFrame:
    """Notes (line_start, line_end) within a changed span or a symbol that one touches."""
    hit = touched(changes, symbols, by).select(by, F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    return touched(hit.unionByName(changes.select(by, "start", "end")), notes, by)


def unmapped(regions: DataFrame, cover: DataFrame, files: DataFrame, by: str, key: list[str]) -> DataFrame:
    """key, reason of the regions (line_start, line_end) that no covering span overlaps: their file is unknown, or only the region."""
    hit = touched(cover, regions, by).select(*key).distinct()
    known = files.select(by).distinct().withColumn("_known", F.lit(True))
    rest = regions.join(hit, key, "left_anti").join(known, by, "left")
    return rest.select(*key, F.when(F.col("_known").isNull(), "unmapped-file").otherwise("unmapped-region").alias("reason"))


def provenance_fixpoint(links: DataFrame, scope: DataFrame) -> DataFrame:
    """id of everything in scope once any link with one end in scope has brought in its other ends.

    ``links``: link, id (one row an end). Each round joins only what the last one added.
    """
    seen = frontier = cut(scope.select("id").distinct(), "scope")
    while True:
        touched = links.join(frontier, "id", "left_semi").select("link").distinct()
        frontier = cut(links.join(touched, "link", "left_semi").select("id").distinct().join(seen, "id", "left_anti"), "scope")
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier), "scope")
