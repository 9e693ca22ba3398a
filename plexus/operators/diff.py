"""Two sides compared: bags, keyed rows, API symbols, renames, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def api_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """status, identity, base_line, head_line. Both sides: identity, signature, line, id.

    Equal signatures of one identity pair off first, as bags; what is left pairs in the order of lines and is changed;
    the rest is removed or added.
    """
    def numbered(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("line", "id")))

    pairs = ["identity", "signature", "rn"]
    b, h = numbered(base, "identity", "signature"), numbered(head, "identity", "signature")
    left = numbered(b.join(h, pairs, "left_anti").drop("rn"), "identity").select("identity", "rn", F.col("line").alias("base_line"))
    right = numbered(h.join(b, pairs, "left_anti").drop("rn"), "identity").select("identity", "rn", F.col("line").alias("head_line"))
    both = left.join(right, ["identity", "rn"], "full_outer")
    status = F.when(F.col("head_line").isNull(), "removed").when(F.col("base_line").isNull(), "added").otherwise("changed")
    return both.select(status.alias("status"), "identity", "base_line", "head_line")


def broken_references(removed_keys: DataFrame, refs: DataFrame) -> DataFrame:
    """ref_id, key: unresolved references of the head that name a removed key; the first rank that does, for each."""
    keyed = refs.where("state <> 'resolved'").select("ref_id", F.posexplode("keys").alias("rank", "key"))
    return keyed.join(removed_keys.select("key").distinct(), "key").groupBy("ref_id").agg(F.min_by("key", "rank").alias("key"))


def bag_diff(old: DataFrame, new: DataFrame, key: list[str], place: str) -> DataFrame:
    """side (removed or added), key columns, place: surplus occurrences of each record key, latest places first to go."""
    number = lambda df: df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(place)))
    a, b = number(old), number(new)
    gone, come = a.join(b, [*key, "rn"], "left_anti"), b.join(a, [*key, "rn"], "left_anti")
    return gone.select(F.lit("removed").alias("side"), *key, place).unionByName(come.select(F.lit("added").alias("side"), *key, place))


def row_diff(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """key, occurrence, status, changed (names of differing columns), ambiguous (the key repeats on a side).

    Rows are known by key and occurrence; the other columns of both sides are compared null-safely.
    """
    number = lambda df: df.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    cells = [c for c in old.columns if c not in (key, order)]
    a = number(old).select(key, "occurrence", F.struct(*cells).alias("_a"))
    b = number(new).select(key, "occurrence", F.struct(*cells).alias("_b"))
    both = a.join(b, [key, "occurrence"], "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in cells]))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changed) > 0, "modified")
    many = F.max("occurrence").over(Window.partitionBy(key)) > 1
    return both.withColumn("status", status).withColumn("ambiguous", many).where("status is not null").select(key, "occurrence", "status", F.when(F.col("status") == "modified", F.array_join(changed, ",")).otherwise("").alias("changed"), "ambiguous")


def coalesce_renames(paths: DataFrame, renames: DataFrame) -> DataFrame:
    """status, old_path, path: a Deleted and an Added path that are a known pair become one Renamed row."""
    gone = paths.where("status = 'D'").select(F.col("path").alias("old_path"))
    come = paths.where("status = 'A'").select("path")
    made = renames.join(gone, "old_path", "left_semi").join(come, "path", "left_semi").select(F.lit("R").alias("status"), "old_path", "path")
    used = made.select(F.lit("D").alias("status"), F.col("old_path").alias("path")).unionByName(made.select(F.lit("A").alias("status"), "path"))
    rest = paths.join(used, ["status", "path"], "left_anti").select("status", F.lit(None).cast("string").alias("old_path"), "path")
    return rest.unionByName(made)


def layers(changes: DataFrame, found: DataFrame) -> DataFrame:
    """path, layers: the layers in which either end of a changed path (path, old_path) appears."""
    ends = changes.select("path", F.explode(F.array_compact(F.array("path", "old_path"))).alias("end"))
    return changes.select("path").distinct().join(ends.join(found.select(F.col("path").alias("end"), "layer"), "end").select("path", "layer").distinct(), "path", "left").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"))


def merge_changes(changes: DataFrame) -> DataFrame:
    """path, whole_file, spans: changes of one path as one row; a path that is deleted and current is current."""
    current = changes.where("status <> 'D'").select("path").distinct().withColumn("_now", F.lit(True))
    kept = changes.join(current, "path", "left").where("status <> 'D' or _now is null")
    return kept.groupBy("path").agg(F.max("whole_file").alias("whole_file"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def duplicates(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, n of keys under which rows differ in what they have to agree in: an invariant that holds gives no rows."""
    return rows.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("n")).where("n > 1")


def orphans(rows: DataFrame, of: DataFrame, key: str, to: str) -> DataFrame:
    """Rows whose ``key`` isn't null and isn't among the ``to`` of the others: a reference that leads nowhere."""
    return rows.where(F.col(key).isNotNull()).join(of.select(F.col(to).alias(key)).distinct(), key, "left_anti")
