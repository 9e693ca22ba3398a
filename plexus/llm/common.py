"""What the operators of this subpackage share: shared storage, sampling for fits, small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests, a laptop) is a temporary folder made and
    set; a cluster without a shared folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plexus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/plexus/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and outlives any executor.

    ``files``, where given, is how many files are written at most; whole partitions are put together for that.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def is_held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3 (a null id: as the empty text)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int | dict[int, int], max_chars: int = 1 << 19, seed: int = 0) -> list[tuple[str, int]]:
    """(text, label) pairs of rows that are not held out, picked by a seeded hash of the id: the same ones on every run.

    ``max_rows`` bounds them in all, or by label. Ids whose labels disagree are left out; of rows that share an id the
    text with the least digest stands, and texts over ``max_chars`` are not learnt from: so the driver gets bounded
    bytes, whatever the tables hold. The ids of the sample, at most ``max_rows`` of them, are broadcast; no text is shuffled but those.
    """
    told = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id")
    told = told.agg(F.min(F.col(label).cast("int")).alias("_label"), F.max(F.col(label).cast("int")).alias("_other")).where("_label = _other").drop("_other")
    line = [F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    if isinstance(max_rows, dict):
        parts = [told.where(F.col("_label") == k).orderBy(*line).limit(n) for k, n in max_rows.items()]
        picked = reduce(DataFrame.unionByName, parts)
    else:
        picked = told.orderBy(*line).limit(max_rows)
    rows = (
        docs.select("doc_id", text_or_empty().alias("_text"))
        .where(F.char_length("_text") <= max_chars)
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id")
        .agg(F.first("_label").alias("_label"), F.min_by("_text", F.xxhash64("_text")).alias("_text"))
        .toPandas()
        .sort_values("doc_id")
    )
    return [(t, int(y)) for t, y in zip(rows["_text"], rows["_label"], strict=True)]
