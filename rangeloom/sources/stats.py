"""Normalisation statistics kept as JSON: {variable: {mean, std, ...}}, bare or below one wrapper key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import finite
from ..session import materialize

# Wrapper keys, tried in this order.
WRAPPERS = ["worldclim_stats", "lat_lon_stats", "topo_normalization_stats", "stats"]
_ENTRY = "map<string,struct<mean:double,std:double,min:double,max:double,count:bigint>>"


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics table `var, mean, std, min, max, count` of a JSON file."""
    text = spark.read.text(path, wholetext=True)
    inner = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in WRAPPERS], F.col("value"))
    return text.select(F.explode(F.from_json(inner, _ENTRY)).alias("var", "s")).select("var", "s.*")


def check_stats(stats: DataFrame, names: list[str]) -> DataFrame:
    """The statistics unchanged; raises when an asked variable is absent, a mean is not finite or a deviation not positive."""
    asked = stats.filter(F.col("var").isin(names))
    usable = F.coalesce(finite(F.col("mean")) & finite(F.col("std")) & (F.col("std") > 0), F.lit(False))
    # One row per asked name, however often the table repeats it.
    have = {r["var"]: r["ok"] for r in asked.groupBy("var").agg(F.bool_and(usable).alias("ok")).collect()}
    missing = sorted(set(names) - set(have))
    if missing:
        raise ValueError(f"no statistics for {missing}")
    bad = sorted(v for v, ok in have.items() if not ok)
    if bad:
        raise ValueError(f"unusable statistics: {bad}")
    return stats


def write_stats(stats: DataFrame, path: str, wrapper: str | None = None) -> None:
    """One JSON document; a statistics table has one row per layer."""
    cols = ["mean", "std", "min", "max", "count"]
    one = stats.agg(F.map_from_entries(F.collect_list(F.struct("var", F.struct(*cols)))).alias("m"))
    doc = F.to_json(F.struct(F.col("m").alias(wrapper))) if wrapper else F.to_json("m")
    one.select(doc.alias("value")).write.text(path)


def stored_stats(spark: SparkSession, path: str, names: list[str], compute: Callable[[], DataFrame], wrapper: str | None = None) -> DataFrame:
    """The checked statistics kept at `path`; where nothing is kept yet, `compute` gives them and they are written first.

    A variable that is missing or has no positive deviation raises, and then nothing is written.
    """
    try:
        return check_stats(read_stats(spark, path), names)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    found = materialize(compute(), "statistics")
    write_stats(check_stats(found, names), path, wrapper)
    return read_stats(spark, path)
