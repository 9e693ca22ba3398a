"""Resolving symbolic references: three-state candidates, aliases, ranked first match, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(node_keys: DataFrame) -> DataFrame:
    """key, n (distinct nodes: 1 is unique, more is ambiguous), target. Absent keys are missing."""
    return node_keys.dropDuplicates(["key", "node_id"]).groupBy("key").agg(F.count("*").alias("n"), F.min("node_id").alias("target"))


def _ranked(refs: DataFrame) -> DataFrame:
    return refs.select("ref_id", "alias_key", F.posexplode("keys").alias("rank", "key"))


def alias_candidates(refs: DataFrame, found: DataFrame) -> DataFrame:
    """key, ambiguous, n, target of exported aliases: exporters resolve by direct keys alone, so chains aren't followed."""
    tried = _ranked(refs.where("alias_key is not null")).join(found, "key")
    first = tried.groupBy("ref_id", "alias_key").agg(F.min_by(F.struct("n", "target"), "rank").alias("hit"))
    unique = F.when(F.col("hit.n") == 1, F.col("hit.target"))
    return first.groupBy(F.col("alias_key").alias("key")).agg(F.max(F.col("hit.n") > 1).alias("ambiguous"), F.count_distinct(unique).alias("n"), F.min(unique).alias("target"))


def references(refs: DataFrame, node_keys: DataFrame) -> DataFrame:
    """refs with state (resolved, missing, ambiguous) and target_id: the first rank that isn't missing decides.

    Direct and alias candidates are merged by rank: ambiguity on either side wins, and two different unique
    nodes are ambiguous. Two equi-joins on key and one aggregate by ref.
    """
    found = candidates(node_keys)
    alias = alias_candidates(refs, found).select("key", F.col("ambiguous").alias("_amb"), F.col("n").alias("_an"), F.col("target").alias("_at"))
    keyed = _ranked(refs).join(found, "key", "left").join(alias, "key", "left")
    own, plain = F.coalesce("n", F.lit(0)), F.col("alias_key").isNull()
    an = F.when(plain, F.coalesce("_an", F.lit(0))).otherwise(0)
    clash = (own > 1) | (plain & F.coalesce("_amb", F.lit(False))) | (an > 1) | ((own == 1) & (an == 1) & (F.col("_at") != F.col("target")))
    state = F.when(clash, 2).when((own == 1) | (an == 1), 1).otherwise(0)
    merged = keyed.select("ref_id", "rank", state.alias("s"), F.when(own > 0, F.col("target")).when(an > 0, F.col("_at")).alias("t")).where("s > 0")
    hit = merged.groupBy("ref_id").agg(F.min_by(F.struct("s", "t"), "rank").alias("hit"))
    out = refs.join(hit, "ref_id", "left")
    return out.withColumn("state", F.when(F.col("hit.s") == 1, "resolved").when(F.col("hit.s") == 2, "ambiguous").otherwise("missing")).withColumn("target_id", F.when(F.col("hit.s") == 1, F.col("hit.t"))).drop("hit")


def edge_support(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_id, kind, support: resolved references counted; calls from tests are TEST_CALLS."""
    kinds = nodes.where("kind = 'test'").select(F.col("id").alias("source_id"), F.lit(True).alias("_test"))
    counted = resolved.where("state = 'resolved'").groupBy("source_id", "target_id", "kind").agg(F.count("*").alias("support")).join(kinds, "source_id", "left")
    return counted.withColumn("kind", F.when((F.col("kind") == "CALLS") & F.col("_test"), "TEST_CALLS").otherwise(F.col("kind"))).drop("_test")


def heritage(pairs: DataFrame, node_keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """implementor_id, trait_id of pairs whose both keys name one type each."""
    types = candidates(node_keys.join(nodes.where("kind = 'type'").select(F.col("id").alias("node_id")), "node_id", "left_semi")).where("n = 1")
    left = types.select(F.col("key").alias("implementor_key"), F.col("target").alias("implementor_id"))
    right = types.select(F.col("key").alias("trait_key"), F.col("target").alias("trait_id"))
    return pairs.join(left, "implementor_key").join(right, "trait_key").where("implementor_id <> trait_id").select("implementor_id", "trait_id").distinct()


def reparent(nodes: DataFrame, node_keys: DataFrame) -> DataFrame:
    """id, parent_id of nodes with an owner key: the one node that it names, else their file."""
    found = candidates(node_keys).where("n = 1").select(F.col("key").alias("owner_key"), "target")
    return nodes.where("owner_key is not null").join(found, "owner_key", "left").select("id", F.coalesce("target", "file_id").alias("parent_id"))


def upgrade_by_index(resolved: DataFrame, definitions: DataFrame) -> DataFrame:
    """ref_id, target_id of unresolved plain calls that stand alone on their line of a source and that an index names.

    ``definitions``: source_id, line, symbol, target_id; a symbol of several targets is no evidence.
    """
    open_ = resolved.where("state <> 'resolved'").withColumn("last", F.regexp_extract(F.get("keys", F.size("keys") - 1), "([^:]*)$", 1))
    alone = open_.groupBy("source_id", "line").agg(F.count("*").alias("n"), F.first("ref_id").alias("ref_id"), F.first("kind").alias("kind"), F.first("alias_key").alias("alias"), F.first("last").alias("symbol")).where("n = 1 and kind = 'CALLS' and alias is null")
    named = definitions.groupBy("source_id", "line", "symbol").agg(F.count_distinct("target_id").alias("d"), F.min("target_id").alias("target_id")).where("d = 1")
    return alone.join(named, ["source_id", "line", "symbol"]).select("ref_id", "target_id")
