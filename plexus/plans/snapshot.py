"""Content-addressed images: identity, publication, reuse, and the delta of a new capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Written into every manifest; an image of another version is refused.
SCHEMA_VERSION = 1


def image_id(files: DataFrame) -> str:
    """A digest of (path, language, content key) of all files, whatever their order: sums of halves of digests."""
    row = files.select(S.framed_hash(F.col("path"), F.col("language"), F.col("content_key")).alias("h"))
    half = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return row.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), half(1), half(16)), 256).alias("id")).first()["id"]


def publish(tables: dict[str, DataFrame], folder: str, image: str) -> str:
    """Write the tables below folder/image and then its manifest, the point from which it counts. An image that is there is reused."""
    spark = next(iter(tables.values())).sparkSession
    path = f"{folder}/{image}"
    if not known(spark, folder, image):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(image, SCHEMA_VERSION, sorted(tables))], "image string, version int, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return path


def known(spark: SparkSession, folder: str, image: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{image}/manifest/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load(spark: SparkSession, folder: str, image: str) -> dict[str, DataFrame]:
    manifest = spark.read.json(f"{folder}/{image}/manifest").first()
    if manifest["version"] != SCHEMA_VERSION:
        raise ValueError(f"image {image} is of version {manifest['version']}")
    return {name: spark.read.parquet(f"{folder}/{image}/{name}") for name in manifest["tables"]}


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, replaced): what has to be parsed again or dropped."""
    a, b = old.select("path", F.col("content_key").alias("_a")), new.select("path", F.col("content_key").alias("_b"))
    both = a.join(b, "path", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select("path", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("replaced").alias("change"))


def apply_delta(rows: DataFrame, changes: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows of unchanged files and those of the delta: derived tables are computed anew from these."""
    return rows.join(changes, "path", "left_anti").unionByName(delta)
