"""Partitioned outputs; a later job reads one species, round or split without scanning the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import order_key
from ..operators import metrics
from ..operators.ranks import exact_rank

PARTITIONS = {
    "points": ["species"],
    "folds": ["species", "cv_round"],
    "dataset": ["species", "design", "cv_round", "split"],
    "eval": ["eval_set"],
}


def write_table(df: DataFrame, path: str, kind: str, allow_existing: bool = False) -> None:
    """Write by the kind's partition columns; an existing target is refused unless allowed.

    Where it is allowed, the folders that `df` has rows for are replaced and the others stay, so a job that runs
    again gives the same table.
    """
    parts = [c for c in PARTITIONS[kind] if c in df.columns]
    # Rows of one folder come together, large folders are split, small ones share a task.
    df = df.hint("rebalance", *[F.col(c) for c in parts])
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if allow_existing else df.write.mode("errorifexists")
    w.option("compression", "zstd").partitionBy(*parts).parquet(path)


def write_evaluation(scored: DataFrame, by: list[str], path: str, allow_existing: bool = False) -> None:
    """The five tables of an evaluation: predictions, summary, class report, ROC and precision-recall curves."""
    parts = {
        "predictions": scored,
        "summary": metrics.full_summary(scored, by),
        "class_report": metrics.class_report(scored, by),
        "roc_curve": metrics.roc_curve(scored, by),
        "pr_curve": metrics.pr_curve(scored, by),
    }
    for name, df in parts.items():
        write_table(df, f"{path}/{name}", "eval", allow_existing)


def write_mosaic(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Mosaic squares; tiles are many, so they share a bounded number of partition folders."""
    d = df.withColumn("tile_bucket", F.pmod(F.xxhash64("tile_id"), F.lit(buckets)).cast("int"))
    d = d.hint("rebalance", F.col("tile_bucket"))
    d.write.mode("errorifexists").partitionBy("tile_bucket").parquet(path)


def skip_finished(tiles: DataFrame, finished: DataFrame) -> DataFrame:
    """Tiles without stored output."""
    return tiles.join(finished.select("tile_id").distinct().hint("merge"), "tile_id", "left_anti")


def trial_key(config_json, stamp):
    """Run key: time stamp and the first ten hex digits of the settings' hash."""
    return F.concat_ws("_", stamp, F.substring(F.sha1(config_json), 1, 10))


def append_trial(result: DataFrame, folds: DataFrame, path: str) -> None:
    """Append the trial row and its fold metrics."""
    result.write.mode("append").parquet(f"{path}/results")
    folds.write.mode("append").parquet(f"{path}/fold_metrics")


def training_batches(df: DataFrame, by: list[str], ident: str, seed: int, epoch: int, batch_size: int) -> DataFrame:
    """Shuffled mini-batches of one epoch; the last, smaller batch is kept."""
    d = df.withColumn("_key", order_key(seed + epoch, F.col(ident)))
    ranked = exact_rank(d, by, "_key", "_rk")
    batch = F.floor(F.col("_rk") / batch_size).cast("long")
    return ranked.withColumn("batch", batch).withColumn("epoch", F.lit(epoch)).drop("_key", "_rk")


def read_partition(spark: SparkSession, path: str, **where) -> DataFrame:
    """Rows of the named partitions."""
    d = spark.read.parquet(path)
    for k, v in where.items():
        d = d.filter(F.col(k) == v)
    return d
