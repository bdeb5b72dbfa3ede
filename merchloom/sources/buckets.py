"""Tables in folders by a hash of their key, so that an upsert writes only the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
NAME = "bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _placed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """One file for each bucket, ordered by the key; a bucket's rows meet in one task, so their number sets the buckets'."""
    return rows.withColumn(NAME, bucket_of(key, buckets)).repartition(NAME).sortWithinPartitions(NAME, key)


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A new table, or the whole of one anew."""
    _placed(rows, key, buckets).write.mode("overwrite").partitionBy(NAME).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(NAME)


def upsert_buckets(changes: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> list[int]:
    """Rows of changes in place of those with their key; the last of several with one key by the column `seq` if there is one.

    Which buckets are touched comes to the driver: `buckets` numbers at most. Only these are read, joined with the changes
    and written, by dynamic partition overwrite; files of the others stay as they are. A null key is a key as any other.
    The table's own columns are kept: what changes lack is null, and what they have besides is left out.
    """
    spark = changes.sparkSession
    if "seq" in changes.columns:
        order = [c for c in changes.columns if c != key]
        last = changes.groupBy(key).agg(F.max_by(F.struct(*order), "seq").alias("last"))
        changes = last.select(key, *[F.col("last")[c].alias(c) for c in order])
    changes = changes.withColumn(NAME, bucket_of(key, buckets))
    touched = sorted(r[0] for r in changes.select(NAME).distinct().collect())
    if not touched:
        return touched
    whole = spark.read.parquet(path)
    old = whole.where(F.col(NAME).isin(touched)).alias("old")
    new = changes.alias("new")
    # read and replaced in one job: what is written is staged, and put in place once all of it is there
    left = old.join(new.select(F.col(key).alias("_k"), F.col(NAME).alias("_b")), F.col(f"old.{key}").eqNullSafe(F.col("_k")) & (F.col(f"old.{NAME}") == F.col("_b")), "left_anti")
    own = [c for c in whole.columns if c != NAME]
    fitted = changes.select(*[(F.col(c) if c in changes.columns else F.lit(None)).cast(whole.schema[c].dataType).alias(c) for c in own])
    rows = left.select(*own).unionByName(fitted)
    _placed(rows, key, buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(NAME).parquet(path)
    return touched
