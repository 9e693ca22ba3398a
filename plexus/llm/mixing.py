"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, text_or_empty


#: So many sources, a short row each, are broadcast.
FEW_SOURCES = 50_000
#: Rows alike that one row is spread out to in a task.
CHUNK = 65_536
_MADE = ("size", "source_size", "target", "times", "taken")


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: float, size: str = "source_size", weight: str = "weight") -> DataFrame:
    """Adds target: ``share`` of all sizes dealt by weight, no source over ``max_epochs`` times its size.

    Sources that fill up first stand first by cap over weight; the level of the rest is what is left over their
    weights. That is where clamping and dealing out the excess again would end. One row a source goes in.
    """
    cap = F.col(size) * F.lit(float(max_epochs))
    rise = Window.orderBy(cap / F.col(weight), weight, size)
    level = (F.sum(F.col(size)).over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(weight).over(
        rise.rowsBetween(0, Window.unboundedFollowing)
    )
    found = sources.withColumn("_level", level).withColumn("_open", cap > F.col("_level") * F.col(weight))
    height = F.max(F.when(F.col("_open"), F.col("_level"))).over(Window.partitionBy())
    return found.withColumn("target", F.when(F.col("_open"), height * F.col(weight)).otherwise(cap)).drop("_level", "_open")


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", buckets: int = 4096, keep: Sequence[str] = (), key: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """(key, source, size, source_size, target, times, taken and the ``keep`` columns) of every row; times is how often the mix has it.

    Sources stand by code point, null last, and have ``weights`` in turn. A source's rate is target over size: every
    document comes the whole number of times, and one more time if it stands early enough in the order of a seeded
    digest of its key, so that the source's words come within half a document of its target, however many keys are null or
    repeat: rows equal in key and size are counted, and as many of them come once more as fit. Reruns agree.

    Only the bucket of that order in which a source's target ends is sorted, one row for rows equal in key and size, to
    find the last that come once more. Then a row is in or out by its own digest, so texts aren't shuffled, but for rows
    of that last entry. Buckets are found by sums over (source, bucket). So a source of any size is spread over
    ``buckets`` groups. Null and empty texts have size 0 and are taken 0 words; kept columns named like new ones are
    replaced; a null source is a source; null keys share one place in the order; repeated rows are
    rows of their own. Sources are a short list: one row each goes through one task. No rows give no rows.
    """
    if not weights or min(weights) <= 0 or share < 0 or max_epochs < 1:
        raise ValueError("weights must be positive, share not negative, max_epochs at least 1")
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    made = [word_count(text).alias("size"), digest.alias("_digest")]
    bucket = (F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int")
    sized = staged(docs.select(key, source, *made).withColumn("_bucket", bucket), "sized")
    parts = staged(sized.groupBy(F.col(source).alias("_source"), "_bucket").agg(F.sum("size").alias("_words")), "parts")
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    turns = F.array(*[F.lit(float(w)) for w in weights])
    sources = parts.groupBy("_source").agg(F.sum("_words").alias("source_size")).withColumn("weight", F.get(turns, F.pmod(place, F.lit(len(weights)))))
    rates = water_fill(sources, share, max_epochs)
    rates = rates.withColumn("_whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long"))
    rates = staged(rates.withColumn("_want", F.col("target") - F.col("_whole") * F.col("source_size")).drop("weight"), "rates")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # The first bucket of a source that isn't in as a whole: all before it are, none after it.
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = parts.withColumn("_before", before).join(rates.select(F.col("_source").alias("_name"), "_want"), same("_source", "_name")).where("_before + _words > _want")
    edges = open_.groupBy("_name", "_want").agg(F.min(F.struct("_bucket", "_before")).alias("_edge")).select("_name", "_want", F.col("_edge._bucket").alias("_part"), F.col("_edge._before").alias("_before"))
    # Rows that are equal in digest, key and size are one entry with a count: all of its first rows are in, up to some number.
    entry = lambda: F.struct("_digest", key, "size")
    edge = sized.join(edges, (F.col("_bucket") == F.col("_part")) & same(source, "_name")).groupBy("_name", "_want", "_before", "_digest", key, "size").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("_name").orderBy("_digest", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_want") - F.col("_before") - F.coalesce(F.sum(F.col("size") * F.col("_n")).over(order), F.lit(0))
    fit = F.when(F.col("_left") <= 0, 0).when(F.col("size") == 0, F.col("_n")).otherwise(F.greatest(F.lit(0), F.least(F.col("_n"), F.floor(F.col("_left") / F.col("size") - 0.5) + 1)))
    edge = edge.withColumn("_left", left).withColumn("_in", fit.cast("long")).where("_in > 0")
    last = edge.groupBy("_name").agg(F.max(F.struct("_digest", key, "size", "_in", "_n")).alias("_l"))
    last = last.select("_name", F.struct("_l._digest", F.col("_l." + f"`{key}`").alias(key), "_l.size").alias("_last"), F.col("_l._in").alias("_in"), F.col("_l._n").alias("_n"))
    plan = rates.join(edges.select(F.col("_name").alias("_e"), "_part"), same("_source", "_e"), "left").join(last, same("_source", "_name"), "left").select("_source", "source_size", "target", "_whole", "_part", "_last", "_in", "_n")
    plan = staged(plan, "plan")
    # A row a source: broadcast where they are few, as they should be, and joined on both sides' shuffles where not.
    plan = F.broadcast(plan) if plan.count() <= FEW_SOURCES else plan
    if keep:
        kept = F.struct(*[c for c in keep if c not in _MADE]).alias("_keep")
        sized = docs.select(key, source, kept, *made).withColumn("_bucket", bucket)
    rows = sized.join(plan, same(source, "_source"))
    in_edge = (F.col("_bucket") == F.col("_part")) & F.col("_last").isNotNull()
    more = F.col("target") > F.col("_whole") * F.col("source_size")
    extra = F.col("_part").isNull() | (F.col("_bucket") < F.col("_part")) | (in_edge & (entry() <= F.col("_last")))
    cut = F.coalesce(more & in_edge & (entry() == F.col("_last")) & (F.col("_in") < F.col("_n")), F.lit(False))
    last_of = lambda df: df.select(key, source, *(["_keep.*"] if keep else []), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))
    plain = rows.where(~cut).withColumn("times", (F.col("_whole") + F.when(extra & more, 1).otherwise(0)).cast("long"))
    # Of the one entry of a source of which only some rows are in: those with the least digest of what is kept, and of
    # rows that are alike in all of it, which are one group with a count, any.
    tied = rows.where(cut).withColumn("_tie", F.xxhash64("_keep") if keep else F.lit(0).cast("long"))
    alike = tied.groupBy("_source", "_tie").agg(*[F.first(c).alias(c) for c in (key, source, *(["_keep"] if keep else []), "size", "source_size", "target", "_whole", "_in")], F.count("*").alias("_n"))
    slot = F.shiftrightunsigned("_tie", 52).cast("int")
    # A running sum over 4,096 slots of the digest, and one within each slot: no task gets a whole entry.
    alike = staged(alike.withColumn("_slot", slot), "tied")
    slots = alike.groupBy("_source", "_slot").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy("_source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(F.col("_source").alias("_s"), F.col("_slot").alias("_k"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_upto"))
    inside = Window.partitionBy("_source", "_slot").orderBy("_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(slots, same("_source", "_s") & (F.col("_slot") == F.col("_k")))
    placed = placed.withColumn("_yes", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_in") - F.col("_upto") - F.col("_own"))))
    parts_of = placed.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_n - 1) div {CHUNK})"))).repartition(F.col("_chunk"), F.col("_tie"))
    single = parts_of.withColumn("_i", F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least(_n, (_chunk + 1) * {CHUNK}) - 1)")))
    single = single.withColumn("times", (F.col("_whole") + F.when(F.col("_i") < F.col("_yes"), 1).otherwise(0)).cast("long"))
    return last_of(plain).unionByName(last_of(single))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
             - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, weight, source_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, weight, source_size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT *, max(CASE WHEN source_size * 2.0::DOUBLE > level * weight THEN level END) OVER () AS height FROM l),
t AS (SELECT source, source_size, CASE WHEN source_size * 2.0::DOUBLE > level * weight THEN height * weight ELSE source_size * 2.0::DOUBLE END AS target FROM m),
r AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
c AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS want,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN before < want AND before + size / 2.0::DOUBLE <= want THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
