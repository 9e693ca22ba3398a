"""Changes of a version-control capture as rows: raw records, patch statistics, merged paths, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of raw records and what they say.
KINDS = {"A": "added", "M": "modified", "D": "deleted", "T": "type-changed", "U": "unmerged", "R": "renamed"}
_HEADER = r"^:([0-7]{6}) ([0-7]{6}) ([0-9a-f]{40}|[0-9a-f]{64}) ([0-9a-f]{40}|[0-9a-f]{64}) (?:([AMDTU])|(R)(100|[0-9]{1,2}))$"


def _some(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def raw_changes(captures: DataFrame, by: str = "capture", text: str = "raw") -> DataFrame:
    """by, n, kind, old_path, path, old_oid, new_oid, old_regular, new_regular, problem: a row for each raw record.

    ``text`` holds records whose fields end with NUL: a header, a path, and for a rename a second one. So that no record is lost, a
    capture that can't be read has one row that says so (problem), not fewer rows. An empty capture has none.
    """
    # A rename's second path is glued to its first, so that each record is a header and one field.
    glued = F.regexp_replace(text, r"(:[0-7]{6} [0-7]{6} \w+ \w+ R\d{1,3})\x00([^\x00]+)\x00([^\x00]+)\x00", "$1\x00$2\x01$3\x00")
    fields = F.split(F.regexp_replace(glued, r"\x00$", ""), "\x00")
    whole = F.col(text).endswith("\x00") & (F.size(fields) % 2 == 0)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest((F.size(fields) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(fields, 2 * i).alias("head"), F.get(fields, 2 * i + 1).alias("paths")))
    sound = whole & F.forall(pairs, lambda p: p["head"].rlike(_HEADER) & (F.octet_length(p["paths"]) > 0))
    given = captures.where(F.octet_length(F.coalesce(F.col(text), F.lit(""))) > 0)
    rows = given.where(sound).select(by, F.posexplode(pairs).alias("n", "p"))
    part = lambda i: F.regexp_extract("p.head", _HEADER, i)
    letter = F.coalesce(_some(part(5)), _some(part(6)))
    ends = F.split("p.paths", "\x01")
    kind = F.get(F.array(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])), F.lit(0))[letter]
    oid = lambda i: F.when(~part(i).rlike("^0+$"), part(i))
    regular = lambda i: part(i).isin("100644", "100755")
    good = rows.select(
        by, "n", kind.alias("kind"), F.when(letter.isin("R", "D"), F.get(ends, F.lit(0))).alias("old_path"), F.when(letter == "R", F.get(ends, F.lit(1))).when(letter != "D", F.get(ends, F.lit(0))).alias("path"),
        oid(3).alias("old_oid"), oid(4).alias("new_oid"), regular(1).alias("old_regular"), regular(2).alias("new_regular"), F.lit(None).cast("string").alias("problem"),
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in good.dtypes[2:-1]]
    bad = given.where(~F.coalesce(sound, F.lit(False))).select(by, F.lit(0).alias("n"), *none, F.lit("malformed-diff-metadata").alias("problem"))
    return good.unionByName(bad)


def apply_stats(changes: DataFrame, stats: DataFrame, omitted: DataFrame, by: list[str]) -> DataFrame:
    """changes with additions, deletions: those of their patch section, null (unknown) where the section was omitted, 0 without one."""
    gone = omitted.select(*by).distinct().withColumn("_omitted", F.lit(True))
    counted = stats.groupBy(*by).agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    rows = changes.join(counted, by, "left").join(gone, by, "left")
    known = lambda c: F.when(F.col("_omitted").isNull(), F.coalesce(F.col(c), F.lit(0))).alias(c)
    return rows.select(*changes.columns, known("additions"), known("deletions"))


def merge_paths(tracked: DataFrame, untracked: DataFrame, by: str = "path") -> DataFrame:
    """path, whole_file, spans, statuses, layers: both sides' rows (path, status, layer, whole_file, spans) as one a path.

    Spans are put together sorted and once each; a path that exists (any status but deleted) is no longer deleted.
    """
    rows = tracked.unionByName(untracked)
    merged = rows.groupBy(by).agg(
        F.max("whole_file").alias("whole_file"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.collect_set("status")).alias("statuses"), F.array_sort(F.collect_set("layer")).alias("layers"),
    )
    alive = F.exists("statuses", lambda s: s != "deleted")
    return merged.withColumn("statuses", F.when(alive, F.filter("statuses", lambda s: s != "deleted")).otherwise(F.col("statuses")))


def selected_layers(paths: DataFrame) -> DataFrame:
    return paths.select(F.explode("layers").alias("layer")).distinct()


def completeness(paths: DataFrame, by: str) -> DataFrame:
    """by, paths, complete: whether each path has both its whole diff and its whole analysis; true of no paths."""
    return paths.groupBy(by).agg(F.count("*").alias("paths"), F.every(F.coalesce(F.col("diff_complete") & F.col("analysis_complete"), F.lit(False))).alias("complete"))


def patch_totals(changes: DataFrame, by: str) -> DataFrame:
    """by, additions, deletions, unknown: known lines added up, and how many paths have none that is known."""
    return changes.groupBy(by).agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count_if(F.col("additions").isNull()).alias("unknown"))


def fold_omissions(omissions: DataFrame) -> DataFrame:
    """path, reason, occurrences: like omissions of a path are one."""
    return omissions.groupBy("path", "reason").agg(F.sum(F.coalesce("occurrences", F.lit(1))).cast("long").alias("occurrences"))


def no_change_reason(changes: Column, same_commit: Column, same_tree: Column, scope: Column) -> Column:
    """Why a review has nothing to show; null if it has."""
    empty = F.when(same_commit, "identical_commit_oids").when(same_tree, "identical_trees").when(scope == "index", "empty_index_delta").when(scope == "worktree", "empty_worktree_delta")
    return F.when(changes == 0, empty)
