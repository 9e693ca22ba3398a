"""Document fingerprints by winnowing, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Buckets of the key's order; their first rows are broadcast, a few bytes each.
MOST_BUCKETS = 1 << 16


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it's named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _rotated(x: Column, by: int) -> Column:
    return x if by % 64 == 0 else F.shiftleft(x, by % 64).bitwiseOR(F.shiftrightunsigned(x, 64 - by % 64))


def _beside(a: Column, b: Column, shift: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of a[i] and b[i + shift], as far as both reach; ``a`` is as long as ``b`` or shorter by less than ``shift``."""
    n = F.least(F.size(a), F.greatest(F.size(b) - shift, F.lit(0)))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), f)


def rolling(words: Column, gram: int) -> Column:
    """Hashes of ``gram`` words in a row, rolled: a cyclic polynomial of the words' own hashes.

    A gram's hash is that of its first words, turned, exclusive-or the next word's. Grams of twice a length come from two
    grams of it in the same way, so each gram costs the logarithm of its length and none is hashed anew.
    """
    def grow(grams: Column, held: int, rest: str) -> Column:
        if not rest:
            return grams
        double = _beside(grams, grams, held, lambda x, y: _rotated(x, held).bitwiseXOR(y))
        if rest[0] == "0":
            return _let(double, lambda g: grow(g, 2 * held, rest[1:]))
        more = lambda g: _beside(g, words, 2 * held, lambda x, y: _rotated(x, 1).bitwiseXOR(y))
        return _let(double, lambda g: _let(more(g), lambda h: grow(h, 2 * held + 1, rest[1:])))

    return grow(words, 1, bin(gram)[3:])


def _least(entries: Column, window: int) -> Column:
    """The least of each ``window`` entries in a row, by minima of windows of half the length."""
    def grow(least: Column, held: int) -> Column:
        shift = min(held, window - held)
        return least if not shift else _let(_beside(least, least, shift, lambda x, y: F.least(x, y)), lambda g: grow(g, held + shift))

    return grow(entries, 1)


def winnow(text: Column, gram: int = 5, window: int = 8, longest: int = 16) -> Column:
    """Fingerprint of a text: an array of (hash, place), a gram's 64 bits and where it starts, counted downwards from 0.

    Grams are ``gram`` pieces in a row; a piece is a word or, of a run of over ``longest`` characters without a space, each
    character: so text without spaces has pieces too, and the same ones wherever it begins. Of each ``window``
    successive gram hashes the smallest is kept, the rightmost of equals, once. Two texts that share
    window + gram - 1 pieces in a row share a hash. Fewer pieces than a gram are one gram, fewer grams than a
    window one window; no pieces, no fingerprint.
    """
    char = r"[^\x20\x09-\x0D]"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?<!{char}){char}{{1,{longest}}}(?!{char})|{char}"), F.lit(0))
    empty = F.array().cast("array<struct<hash:bigint,place:int>>")
    placed = lambda grams: F.transform(grams, lambda h, i: F.struct(h.alias("hash"), (-i).alias("place")))

    def chosen(entries: Column) -> Column:
        # Kept places never go back, so equals stand side by side.
        once = lambda least: F.filter(least, lambda x, i: (i == 0) | (x["place"] != F.get(least, F.greatest(i - 1, F.lit(0)))["place"]))
        return F.when(F.size(entries) <= window, F.array(F.array_min(entries))).otherwise(_let(_least(entries, window), once))

    def grams(words: Column) -> Column:
        return F.when(F.size(words) <= gram, F.array(F.xxhash64(words))).otherwise(rolling(words, gram))

    some = lambda words: _let(grams(words), lambda g: _let(placed(g), chosen))
    return _let(F.transform(pieces, lambda p: F.xxhash64(p)), lambda words: F.when(F.size(words) == 0, empty).otherwise(some(words)))


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def positions(fingerprint: Column) -> Column:
    """Where each kept gram starts, in pieces."""
    return F.transform(fingerprint, lambda x: -x["place"])


def digest(fingerprint: Column) -> Column:
    """128 bits of hashes and positions as text."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(fingerprint, F.lit(k))), 16, "0") for k in (1, 2)]))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 if neither has any."""
    return _let(F.size(F.array_union(a, b)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / n))


def _bucket(key: Column, splits: list[int], fan: int = 256) -> Column:
    """How many splits are at most the key, found in two steps of at most ``fan`` comparisons."""
    groups = [splits[i : i + fan] for i in range(0, len(splits), fan)] or [[]]
    upto = lambda some, k: F.size(F.filter(some, lambda s: s <= k))
    longs = lambda some: F.array(*[F.lit(int(s)).cast("long") for s in some]).cast("array<long>")
    outer = upto(longs([g[0] for g in groups[1:]]), key)
    inner = F.get(F.array(*[longs(g) for g in groups]), outer)
    return outer * fan + upto(inner, key)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 2000, derive: Callable[[DataFrame], DataFrame] = lambda d: d, carry: tuple[str, ...] = ("_text",)) -> DataFrame:
    """Each row with ``next``, a struct of the ``carry`` columns of the row that follows by key (the first after the last).

    Rows are dealt once, to buckets of the key's order whose limits come from its approximate quantiles; these decide
    balance, not results. The first rows of a bucket go to the one before as well. ``derive`` adds columns in between.
    Rows of one key stand by text; null keys stand last. Keys that aren't whole numbers are refused.
    """
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} must be a whole number")
    place = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))
    base = docs.select(F.col(key), place.alias("_place"), text_or_empty(text).alias("_text"))
    n = docs.count()
    count = max(1, min(MOST_BUCKETS, -(-n // rows)))
    found = docs.agg(F.percentile_approx(place, [i / count for i in range(1, count)], 100_000)).first()[0] if count > 1 and n else None
    splits = sorted({*(found or [])})
    base = base.withColumn("_bucket", _bucket(F.col("_place"), splits))
    line = Window.orderBy("_bucket")
    first = base.groupBy("_bucket").agg(F.min("_place").alias("_first"))
    # One row a bucket, at most MOST_BUCKETS: small enough for one task and to be broadcast.
    first = first.withColumn("_last", F.max("_bucket").over(Window.partitionBy())).withColumn("_prior", F.lag("_bucket").over(line))
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("turn"), F.lit(False).alias("halo"))
    other = F.struct(F.coalesce("_prior", "_last").alias("bucket"), F.when(F.col("_prior").isNull(), 1).otherwise(0).alias("turn"), F.lit(True).alias("halo"))
    dealt = base.join(F.broadcast(first), "_bucket").select(key, "_place", "_text", F.explode(F.when(F.col("_place") == F.col("_first"), F.array(own, other)).otherwise(F.array(own))).alias("_to"))
    dealt = dealt.select(key, "_place", "_text", "_to.*").repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("turn", "_place", "halo", "_text")
    return derive(dealt).withColumn("next", F.lead(F.struct(*carry)).over(order)).where(~F.col("halo")).drop("_place", "bucket", "turn", "halo")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = 5, window: int = 8) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text with its last quarter (code points, rounded down) replaced by the first as many, or
    all, of the next text. Null texts count as empty. Repeated keys stand by text, null keys last; the only row is its own
    next. Texts are shuffled once, and a bucket is sorted within one task, which may spill.
    """
    both = with_next(docs, key, text, derive=lambda d: d.withColumn("_print", winnow(F.col("_text"), gram, window)), carry=("_text", "_print"))
    n, q = F.char_length("_text"), F.floor(F.char_length("_text") / 4).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - q), F.substring("next._text", F.lit(1), q))
    rows = both.select(key, n.cast("long").alias("n_chars"), edited.alias("_edited"), "_print", hashes(F.col("next._print")).alias("_next"))
    rows = rows.select("*", winnow(F.col("_edited"), gram, window).alias("_edited_print"))
    mine = hashes(F.col("_print"))
    return rows.select(
        key, "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), digest(F.col("_print")).alias("fingerprint"), digest(F.col("_edited_print")).alias("edited_fingerprint"),
        likeness(mine, hashes(F.col("_edited_print"))).alias("near_edited"), likeness(mine, F.col("_next")).alias("near_next"),
    )
