"""Listings of block files, without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str | list[str], suffix: str = ".blk") -> DataFrame:
    """(path, size, modified) of all files with the suffix below ``path``, each once, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).dropDuplicates(["path"]).orderBy("path")


def segments(spark: SparkSession, path: str, base: str, suffix: str = ".blk") -> DataFrame:
    """Files base.blk (segment 0) and base-N.blk (segment N) with their numbers, in numeric order."""
    pattern = rf"/{base}(?:-([0-9]+))?\{suffix}$"
    number = F.coalesce(F.expr("try_cast(nullif(x, '') as bigint)"), F.lit(0).cast("long"))
    rows = manifest(spark, path, suffix).filter(F.col("path").rlike(pattern)).withColumn("x", F.regexp_extract("path", pattern, 1))
    return rows.withColumn("segment", number).drop("x").orderBy("segment")
