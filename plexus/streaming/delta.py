"""Re-indexing as a stream: each micro-batch of files is applied to the image before it, and references are resolved anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import resolve
from ..plans import snapshot
from ..sources import python_code


def follow(files: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a stream that hands each micro-batch to ``apply``, once for each batch id, as far as there is input."""
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version(batch: int) -> str:
    return f"batch-{batch:010d}"


def latest(spark: SparkSession, folder: str, before: int) -> int | None:
    """The last batch before ``before`` whose image is whole."""
    return next((b for b in range(before - 1, -1, -1) if snapshot.known(spark, folder, version(b))), None)


def apply_files(batch: DataFrame, number: int, folder: str) -> str:
    """Publish the image after a batch of files (path, content, seq): rows, files, nodes, refs, edges. Returns its folder.

    The row with the highest ``seq`` of a path counts; a null content removes the file. Only files of the batch are parsed; all
    references are resolved against all keys, since a new file can answer, or make doubtful, what others ask. A batch
    that runs again finds its image, or makes the same one: so a restart neither loses nor doubles anything.
    """
    spark = batch.sparkSession
    if snapshot.known(spark, folder, version(number)):
        return f"{folder}/{version(number)}"
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq"), F.desc(F.xxhash64("content"))))
    given = batch.where(F.col("path").isNotNull()).withColumn("_n", place).where("_n = 1").select("path", "content")
    alive = given.where("content is not null")
    rows, files = python_code.python_rows(alive), alive.select("path", F.sha2("content", 256).alias("content_key"))
    prior = latest(spark, folder, number)
    if prior is not None:
        held = snapshot.load(spark, folder, version(prior))
        gone = given.select("path")
        rows, files = (snapshot.apply_delta(held[name], gone, new) for name, new in (("rows", rows), ("files", files)))
    first = snapshot.publish({"rows": rows, "files": files}, folder, f"{version(number)}-rows")
    rows, files = spark.read.parquet(f"{first}/rows"), spark.read.parquet(f"{first}/files")
    tables = python_code.graph_tables(rows)
    resolved = resolve.references(tables["refs"], tables["node_keys"])
    made = {"rows": rows, "files": files, "nodes": tables["nodes"], "refs": resolved, "edges": resolve.edge_support(resolved, tables["nodes"])}
    return snapshot.publish(made, folder, version(number))


def follow_files(files: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep images of a stream of files (path, content, seq) in ``folder``, one for each micro-batch."""
    return follow(files, lambda df, n: apply_files(df, n, folder) and None, checkpoint)
