"""Incremental jobs over landing folders: thinned occurrences and the running trial best.

State lives in the streaming aggregation; each batch stores only the keys it changed, so a batch
costs what arrived, not what has been seen. Stored updates are monotone (the smaller order key, the
better trial), so re-running a batch or reading several updates of one key is harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import order_key
from ..operators.clean import clean_coords, uncertainty_filter
from ..operators.sampling import Grid, first_by, with_cell


def _run(updates: DataFrame, out: str, checkpoint: str) -> None:
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (
        updates.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def stream_occurrences(
    spark: SparkSession, landing: str, schema: str, out: str, checkpoint: str, grid: Grid, seed: int = 42,
    max_uncertainty_m: float | None = None, files_per_batch: int = 1000,
) -> DataFrame:
    """Take in new occurrence files (`occ_id, species, lat, lon, uncertainty`, as text or numbers) and return one record per species and cell.

    Equal to thinning all files at once, whatever order they arrive in.
    """
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    d = clean_coords(uncertainty_filter(src, "uncertainty", max_uncertainty_m))
    d = with_cell(d, grid).withColumn("order_key", order_key(seed, F.col("occ_id")))
    row = F.struct("occ_id", "lat", "lon", "order_key")
    best = d.groupBy("species", "cell_row", "cell_col").agg(F.min_by(row, "order_key").alias("_r"))
    _run(best.select("species", "cell_row", "cell_col", "_r.*"), out, checkpoint)
    return first_by(spark.read.parquet(out).drop("batch"), ["species", "cell_row", "cell_col"], "order_key")


def stream_trials(spark: SparkSession, landing: str, schema: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """Take in new trial rows and return each benchmark's best trial by the ratchet order."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    # Larger wins; missing values sort lowest, a missing loss highest.
    rank = F.struct(
        "mean_val_mcc", "mean_val_auc", "mean_val_sensitivity", "mean_val_specificity",
        F.coalesce(-F.col("mean_val_loss"), F.lit(float("-inf"))).alias("low_loss"), "run_id",
    )
    best = src.filter("mean_val_mcc IS NOT NULL").groupBy("benchmark_name").agg(F.max(rank).alias("best"))
    _run(best, out, checkpoint)
    latest = spark.read.parquet(out).groupBy("benchmark_name").agg(F.max("best").alias("best"))
    return latest.select("benchmark_name", "best.run_id", "best.mean_val_mcc", "best.mean_val_auc")
