"""Ranking and comparison of modelling trials, kept apart by `benchmark_name`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, setting_texts, settings_equal, to_number
from ..session import materialize
from .joins import salted_join
from .ranks import before, quantiles, sorted_rank

# Settings compared between trials, in report order.
SETTINGS = [
    "model_type", "optimizer", "scheduler", "learning_rate", "weight_decay", "batch_size", "seed", "dropout",
    "hidden_dim", "env_feature_dim", "topo_feature_dim", "pretrained_image", "lr_patience", "lr_factor",
]
SAME = "baseline / repeat"
BENCH = "benchmark_name"


def run_time(run_id: Column) -> Column:
    """Start time from the first 15 characters of a run id; malformed ids have none."""
    return F.try_to_timestamp(F.substring(run_id, 1, 15), F.lit("yyyyMMdd_HHmmss"))


def numbered(df: DataFrame) -> DataFrame:
    """`run_time` and the ordinal `trial` within the benchmark, by (run time, run id)."""
    d = df.withColumn("run_time", run_time(F.col("run_id")))
    return sorted_rank(d, [BENCH], [F.col("run_time").asc_nulls_last(), F.col("run_id").asc()], "trial")


def with_settings(df: DataFrame) -> DataFrame:
    """`logged`: settings as written in the search space; `settings`: the trial's own columns first."""
    raw = F.from_json(F.nullif(F.trim("search_space_json"), F.lit("")), "map<string,string>")
    d = df.withColumn("_m", raw)
    logged = F.struct(*[F.col("_m")[k].alias(k) for k in SETTINGS])

    def own(k: str) -> Column:
        return F.coalesce(F.col(k).cast("string"), F.col("_m")[k]) if k in df.columns else F.col("_m")[k]

    return d.withColumn("logged", logged).withColumn("settings", F.struct(*[own(k).alias(k) for k in SETTINGS])).drop("_m")


def changes(current: Column, prior: Column) -> Column:
    """Text of the settings that differ, in report order."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), current[k].alias("now"), prior[k].alias("old")) for k in SETTINGS])
    moved = F.filter(pairs, lambda p: p["now"].isNotNull() & ~settings_equal(p["now"], p["old"]))
    texts = [setting_texts(F.transform(moved, lambda p: p["old"])), setting_texts(F.transform(moved, lambda p: p["now"]))]
    rows = F.arrays_zip(F.transform(moved, lambda p: p["k"]).alias("k"), texts[0].alias("old"), texts[1].alias("now"))
    line = F.array_join(F.transform(rows, lambda p: F.concat(p["k"], F.lit(": "), p["old"], F.lit(" -> "), p["now"])), "; ")
    return F.when(F.size(moved) == 0, F.lit(SAME)).otherwise(line)


def best_so_far(df: DataFrame) -> DataFrame:
    """Ordinal, running best MCC, whether the trial reaches it, and whether several rows share that best."""
    # Ordinals are dense, so ranges of them are even buckets.
    d = before(numbered(df), [BENCH], F.shiftright("trial", 18), F.shiftright("trial", 9), [F.col("trial")], maxes=["mean_val_mcc"])
    v = F.col("mean_val_mcc")
    d = d.withColumn("best_so_far_mcc", F.when(v.isNotNull(), F.greatest(v, F.col("mean_val_mcc_before"))))
    d = d.drop("mean_val_mcc_before")
    d = materialize(d.withColumn("is_new_best", F.coalesce(v == F.col("best_so_far_mcc"), F.lit(False))), "running_best")
    share = d.groupBy(BENCH, "best_so_far_mcc").agg(F.count(F.lit(1)).alias("_n")).filter("best_so_far_mcc IS NOT NULL")
    d = salted_join(d, share, [BENCH, "best_so_far_mcc"], "left", "run_id")
    return d.withColumn("is_repeat_best", F.col("is_new_best") & (F.coalesce("_n", F.lit(0)) > 1)).drop("_n")


def enriched(df: DataFrame) -> DataFrame:
    """Ordinal, settings, running best, one-line summary and the three comparisons."""
    d = materialize(with_settings(best_so_far(df)), "trials")
    prev = d.select(BENCH, (F.col("trial") + 1).alias("trial"), F.col("logged").alias("_prev"))
    ends = d.groupBy(BENCH).agg(
        F.min_by("logged", "trial").alias("_base"),
        F.max_by("settings", F.when(F.col("mean_val_mcc").isNotNull(), F.struct("mean_val_mcc", -F.col("trial")))).alias("_best"),
    )
    # One row per benchmark: the planner broadcasts it under its size limit.
    d = d.join(prev, [BENCH, "trial"], "left").join(ends, BENCH)
    now = F.col("settings")
    return (
        d.withColumn("changes_vs_previous", changes(now, F.coalesce("_prev", "_base")))
        .withColumn("changes_vs_baseline", changes(now, F.col("_base")))
        .withColumn("changes_vs_best", changes(now, F.col("_best")))
        .withColumn("config_summary", one_line(now))
        .withColumn("run_folder", base_name(F.col("run_dir")))
        .drop("_prev", "_base", "_best")
    )


def one_line(s: Column) -> Column:
    """One-line description of a trial; numeric settings that are missing print as nan."""
    short = {"lr": "learning_rate", "wd": "weight_decay", "drop": "dropout", "pat": "lr_patience", "seed": "seed"}
    head = [F.coalesce(s["model_type"], F.lit("None")), F.concat(F.lit("opt="), F.coalesce(s["optimizer"], F.lit("None")))]
    nums = setting_texts(F.array(*[F.coalesce(s[v], F.lit("nan")) for v in short.values()]))
    body = F.zip_with(F.array(*[F.lit(f"{k}=") for k in short]), nums, lambda a, b: F.concat(a, b))
    return F.concat_ws(", ", *head, F.array_join(body, ", "), F.when(F.lower(s["pretrained_image"]).isin("false", "0"), "no_pretrain"))


def ratchet_rank(df: DataFrame) -> DataFrame:
    """Rank by the primary metric, then the tie-breakers; missing values last."""
    keys = [("mean_val_mcc", True), ("mean_val_auc", True), ("mean_val_sensitivity", True), ("mean_val_specificity", True), ("mean_val_loss", False)]
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]
    return sorted_rank(df, [BENCH], [*order, F.col("run_id").asc()], "ratchet_rank")


def top_runs(df: DataFrame, n: int = 20) -> DataFrame:
    """Best `n` trials: four metrics downwards, loss upwards, missing last."""
    down = [F.col(c).desc_nulls_last() for c in ("mean_val_mcc", "mean_val_auc", "mean_val_sensitivity", "mean_val_specificity")]
    return df.orderBy(*down, F.col("mean_val_loss").asc_nulls_last(), "run_id").limit(n)


def top_by_mcc(df: DataFrame, n: int = 15) -> DataFrame:
    """Best `n` trials by MCC."""
    return df.orderBy(F.col("mean_val_mcc").desc_nulls_last(), "run_id").limit(n)


def family_summary(df: DataFrame) -> DataFrame:
    """Count and best, median and lowest metrics per model family, best family first."""
    a = df.groupBy("model_type").agg(
        F.count("run_id").alias("n"),
        F.max("mean_val_mcc").alias("best_mcc"),
        F.max("mean_val_auc").alias("best_auc"),
        F.min("mean_val_loss").alias("best_loss"),
    )
    m = quantiles(df, ["model_type"], "mean_val_mcc", {"median_mcc": 0.5})
    return a.join(m, "model_type", "left").orderBy(F.col("best_mcc").desc_nulls_last(), "model_type")


def family_box(df: DataFrame) -> DataFrame:
    """Five-number summary of MCC per family."""
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return quantiles(df, ["model_type"], "mean_val_mcc", probs)


def hyperparam_slices(df: DataFrame, family: str = "image_topo_tabular") -> DataFrame:
    """Best MCC per value of four settings, for one family; input from `with_settings`."""
    fields = ["learning_rate", "dropout", "lr_patience", "seed"]
    d = df.filter(F.col("settings.model_type") == family)
    d = d.select("mean_val_mcc", *[to_number(F.col(f"settings.{k}")).alias(k) for k in fields])
    long = d.unpivot(["mean_val_mcc"], fields, "setting", "value").filter(F.col("value").isNotNull())
    return long.groupBy("setting", "value").agg(F.max("mean_val_mcc").alias("best_mcc"))


def seed_runs(df: DataFrame) -> DataFrame:
    """Trials with seed 42, or whose seed differs from the best trial's; input from `enriched`."""
    return df.filter(F.col("changes_vs_best").contains("seed:") | (to_number(F.col("settings.seed")) == 42))
