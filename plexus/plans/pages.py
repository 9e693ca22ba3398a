"""Pages of long reviews: lines by their byte offsets, a page from a cursor, what each section may take, tokens to go on from."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_TOKEN = 256
_NUMBER = "(0|[1-9][0-9]*)"
_TOKEN = re.compile(rf"v3:{':'.join([_NUMBER] * 7)}:([0-9a-f]{{64}}):([0-9a-f]{{64}})")


def with_offsets(lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """lines with first and stop: the bytes of each ``by`` that a line and its line end take, counted over its lines in order."""
    size = F.octet_length(text).cast("long") + 1
    stop = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("stop", stop).withColumn("first", F.col("stop") - size)


def page(lines: DataFrame, cursors: DataFrame, by: str, order: str, text: str, most: int = 1 << 30) -> DataFrame:
    """by, start, end, text, records, partial, total: the page of each ``by`` that begins at its cursor (by, start, budget).

    A page has the whole lines that fit in its budget of bytes, ``most`` at most, of the first one what the cursor leaves
    of it. If not even that one fits, it has as many of its characters as do, and is partial; a budget for no character
    gives an end at the start. A cursor at or beyond the total has no page.
    """
    placed = with_offsets(lines, by, order, text)
    total = placed.groupBy(by).agg(F.max("stop").alias("total"))
    rest = placed.join(cursors.select(by, "start", "budget"), by).where("stop > start")
    rest = rest.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    bytes_ = F.encode(F.concat(F.col(text), F.lit("\n")), "utf-8")
    skip = F.greatest(F.col("start") - F.col("first"), F.lit(0)).cast("int")
    fits = F.col("stop") <= F.col("start") + F.col("budget")
    own = F.decode(F.substring(bytes_, skip + 1, F.octet_length(bytes_)), "utf-8")
    whole = rest.where(fits & (F.col("_n") <= most)).groupBy(by, "start").agg(
        F.max("stop").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", own.alias("_t")))), lambda x: x["_t"]), "").alias("text"), F.count("*").alias("records"), F.lit(False).alias("partial")
    )
    # The last place in the budget at which a character begins: a byte of 10xxxxxx continues one.
    begins = lambda k: ~F.hex(F.substring(bytes_, skip + F.col("budget").cast("int") - k + 1, F.lit(1))).rlike("^[89AB]")
    back = F.when(begins(0), 0).when(begins(1), 1).when(begins(2), 2).otherwise(3)
    cut = rest.where((F.col("_n") == 1) & ~fits).withColumn("_len", F.greatest(F.col("budget").cast("int") - back, F.lit(0)))
    cut = cut.select(by, "start", (F.col("start") + F.col("_len")).alias("end"), F.decode(F.substring(bytes_, skip + 1, F.col("_len")), "utf-8").alias("text"), F.lit(0).cast("long").alias("records"), F.lit(True).alias("partial"))
    return whole.unionByName(cut).join(total, by)


def shares(sections: DataFrame, budget: int, by: str, order: str) -> DataFrame:
    """sections (by, order, unfinished) with budget: dealt evenly to those that are unfinished, the remainder to the first of them."""
    whole, before = Window.partitionBy(by), Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.col("unfinished").cast("int")
    count, turn = F.sum(open_).over(whole), F.sum(open_).over(before)
    each = F.floor(F.lit(budget) / F.nullif(count, F.lit(0)))
    return sections.withColumn("budget", F.when(F.col("unfinished"), each + (turn <= budget % count).cast("int")).otherwise(0).cast("long"))


@dataclass(frozen=True)
class Cursor:
    """Where each of five sections goes on, in a review of these parameters."""

    offsets: tuple[int, int, int, int, int]
    depth: int
    max_nodes: int
    snapshot: str

    def check(self, review: str) -> str:
        held = "|".join(map(str, (*self.offsets, self.depth, self.max_nodes, self.snapshot, len(review))))
        return hashlib.sha256(f"place in a review|{held}|{review}".encode()).hexdigest()

    def token(self, review: str) -> str:
        return ":".join(["v3", *map(str, (*self.offsets, self.depth, self.max_nodes)), self.snapshot, self.check(review)])


def read_token(token: str, review: str, depth: int, max_nodes: int, snapshot: str) -> Cursor:
    """The cursor of a token that was given for this review, snapshot and parameters; others raise ValueError."""
    found = _TOKEN.fullmatch(token) if len(token) <= MAX_TOKEN else None
    if not found:
        raise ValueError("invalid cursor")
    *numbers, given, check = found.groups()
    cursor = Cursor(tuple(map(int, numbers[:5])), int(numbers[5]), int(numbers[6]), given)
    if cursor.snapshot != snapshot:
        raise ValueError("cursor_snapshot_mismatch")
    if (cursor.depth, cursor.max_nodes) != (depth, max_nodes):
        raise ValueError("cursor_parameters_mismatch")
    if cursor.check(review) != check:
        raise ValueError("invalid cursor")
    return cursor
