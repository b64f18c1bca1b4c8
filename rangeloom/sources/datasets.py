"""Model-ready data sets and trial logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns of the trial log.
TRIAL_SCHEMA = (
    "run_id string, benchmark_name string, model_type string, primary_metric string, primary_value double, mean_val_loss double, "
    "mean_val_acc double, mean_val_balanced_acc double, mean_val_mcc double, mean_val_auc double, mean_val_avg_precision double, "
    "mean_val_precision double, mean_val_sensitivity double, mean_val_specificity double, elapsed_seconds double, epochs_requested int, "
    "epochs_completed int, n_datasets int, optimizer string, scheduler string, learning_rate double, weight_decay double, batch_size int, "
    "seed int, search_space_json string, env_features_json string, run_dir string"
)


def read_dataset(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of one split (a pruned scan of the partitioned table); missing columns or an empty split raise."""
    d = spark.read.parquet(path)
    for c in ("split", "presence"):
        if c not in d.columns:
            raise ValueError(f"data set without a {c} column")
    d = d.filter(d.split == split)
    if d.isEmpty():
        raise ValueError(f"no rows for split {split!r}")
    return d


def read_trials(spark: SparkSession, path: str, schema: str = TRIAL_SCHEMA) -> DataFrame:
    """Tab-separated trial log with an explicit schema."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"', escape='"')
