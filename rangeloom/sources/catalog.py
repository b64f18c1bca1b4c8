"""File listings as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name


def list_rasters(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Paths of raster files; contents are pruned from the scan."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][iI][fF]").option("recursiveFileLookup", str(recursive).lower())
    return r.load(path).select("path", "length")


def raster_file_catalog(paths: DataFrame) -> DataFrame:
    """Lower-case base name to path; the greatest path stands for repeated names."""
    return paths.groupBy(F.lower(base_name(F.col("path"))).alias("name")).agg(F.max("path").alias("path"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """Paths without repeats that differ only in case; the smallest spelling stays."""
    return paths.groupBy(F.lower("path").alias("_k")).agg(F.min("path").alias("path")).drop("_k")
