"""Splits, spatial folds and dataset-level normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import order_key
from ..session import materialize
from .joins import same_keys_join
from .ranks import earlier_counts, exact_rank, quantiles


def split_label(rank: Column, n: Column, train: float, val: float, leftover_to_test: bool) -> Column:
    """train / val / test by rank; counts are rounded half to even, leftovers go to test or to val."""
    n = n.cast("double")
    n_train = F.bround(n * F.lit(train))
    n_val = F.bround(n * F.lit(val))
    rest = F.lit("test") if leftover_to_test else F.lit("val")
    return F.when(rank < n_train, "train").when(rank < n_train + n_val, "val").otherwise(rest)


def stratified_split(
    df: DataFrame, by: list[str], key: str, train: float, val: float, leftover_to_test: bool = True
) -> DataFrame:
    """Seeded split inside every (by, presence) group."""
    ranked = exact_rank(df, [*by, "presence"], key, "_rk", total="_n")
    return ranked.withColumn("split", split_label(F.col("_rk"), F.col("_n"), train, val, leftover_to_test)).drop("_rk", "_n")


def spatial_blocks(df: DataFrame, by: list[str], size_m: float) -> DataFrame:
    """Square blocks counted from the group's lower left corner; input has projected `x, y`."""
    low = df.groupBy(*by).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    # Stored, small tables show the planner their size, so that it need not shuffle the points to join them.
    d = same_keys_join(df, materialize(low, "corners"), by)
    d = d.withColumn("block_x", F.floor((F.col("x") - F.col("_x0")) / size_m).cast("int"))
    d = d.withColumn("block_y", F.floor((F.col("y") - F.col("_y0")) / size_m).cast("int"))
    return d.withColumn("block_id", F.concat_ws("_", "block_x", "block_y")).drop("_x0", "_y0")


def fold_map(df: DataFrame, by: list[str], k: int, seed: int) -> DataFrame:
    """Block to fold 1..k: blocks in seeded order dealt round robin."""
    blocks = df.select(*by, "block_id").distinct().withColumn("_key", order_key(seed, F.col("block_id")))
    ranked = exact_rank(blocks, by, "_key", "_rk")
    return ranked.select(*by, "block_id", (F.pmod("_rk", F.lit(k)) + 1).cast("int").alias("fold"))


def assign_folds(df: DataFrame, by: list[str], k: int, seed: int) -> DataFrame:
    """Attach the fold of each point's block; a few rows per group, joined under the planner's size check."""
    return same_keys_join(df, materialize(fold_map(df, by, k, seed), "fold_map"), [*by, "block_id"])


def reattach_fold(df: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """Recover fold and block by coordinate for rows that lost them."""
    keys = [*by, "lat", "lon"]
    return df.join(points.select(*keys, "fold", "block_id").distinct(), keys, "left")


def cv_labels(df: DataFrame, by: list[str], key: str, k: int, legacy_remainder: bool = False, out: str = "splits") -> DataFrame:
    """Each point's splits in rounds 1..k as an array: its own fold is tested, the rest split 70 / 30 by class.

    The row left over by rounding goes to val; `legacy_remainder` labels it test instead. A point's ranks in all rounds
    follow from the folds of the points before it, so points are shuffled once.
    """
    rounds = range(1, k + 1)
    marks = {f"_f{r}": F.col("fold") == r for r in rounds} | {"_any": F.col("fold").isNotNull(), "_none": F.col("fold").isNull()}
    d = earlier_counts(df, [*by, "presence"], key, marks)

    def label(r: int) -> Column:
        # Points without a fold are a group of their own.
        rank, n = (F.when(F.col("fold").isNull(), F.col(f"_none_{c}")).otherwise(F.col(f"_any_{c}") - F.col(f"_f{r}_{c}")) for c in ("before", "total"))
        return F.when(F.col("fold") == r, "test").otherwise(split_label(rank, n, 0.70, 0.30, legacy_remainder))

    return d.select(*df.columns, F.array(*[label(r) for r in rounds]).alias(out))


def cv_rounds(df: DataFrame, by: list[str], key: str, k: int, legacy_remainder: bool = False) -> DataFrame:
    """Every point once per round with its split, see `cv_labels`; points are repeated after the shuffle."""
    keep = [c for c in df.columns if c not in ("cv_round", "split")]
    d = cv_labels(df, by, key, k, legacy_remainder, "_splits").select(*keep, F.posexplode("_splits").alias("cv_round", "split"))
    return d.withColumn("cv_round", F.col("cv_round") + 1)


def sample_ids(df: DataFrame, by: list[str], key: str, cv: bool = False) -> DataFrame:
    """Sample id and chip names from the rank inside the data set."""
    return sample_names(exact_rank(df, by, key, "_rk"), cv)


def sample_names(d: DataFrame, cv: bool = False) -> DataFrame:
    """Sample id and chip names of rows with their rank `_rk` inside the data set."""
    tail = F.concat(F.lit("_CV"), F.col("cv_round")) if cv else F.lit("")
    kind = F.when(F.col("presence") == 1, "pres").otherwise("abs")
    chip = F.concat_ws("_", F.lit("chip"), "_rk", kind, "split")
    d = d.withColumn("sample_id", F.concat(F.concat_ws("_", "_rk", "presence", "split"), tail))
    d = d.withColumn("chip_path", F.concat(F.lit("images/"), chip, tail))
    return d.withColumn("topo_chip_path", F.concat(F.lit("topo_chips/topo_"), chip, tail)).drop("_rk")


def coord_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of the coordinates per data set; keep it with the data for scoring."""
    return df.groupBy(*by).agg(
        F.avg("lat").alias("lat_mean"), F.stddev_samp("lat").alias("lat_std"),
        F.avg("lon").alias("lon_mean"), F.stddev_samp("lon").alias("lon_std"),
    )


def norm_latlon(df: DataFrame, by: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Z-scores of the coordinates per data set; 0 where the deviation is 0 or undefined."""
    d = same_keys_join(df, materialize(coord_stats(df, by), "coord_stats") if stats is None else stats, by)
    for c in ("lat", "lon"):
        sd = F.nullif(F.col(f"{c}_std"), F.lit(0.0))
        d = d.withColumn(f"{c}_norm", F.coalesce((F.col(c) - F.col(f"{c}_mean")) / sd, F.lit(0.0)))
    return d.drop("lat_mean", "lat_std", "lon_mean", "lon_std")


def class_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per class."""
    return df.groupBy(*by, "presence").agg(F.count(F.lit(1)).alias("n"))


def distance_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Smallest, median and largest distance to the nearest presence."""
    return quantiles(df, by, "nearest_presence_km", {"min_km": 0.0, "median_km": 0.5, "max_km": 1.0})


def occurrence_qa(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, distinct coordinates and the uncertainty range of cleaned occurrences."""
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    places = df.select(*by, "lat", "lon").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_places"))
    q = quantiles(df, by, "coordinate_uncertainty_m", {"unc_min": 0.0, "unc_median": 0.5, "unc_max": 1.0})
    return same_keys_join(same_keys_join(rows, places, by), q, by, "left")


def source_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per source."""
    return df.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n"))


def union_points(presences: DataFrame, background: DataFrame) -> DataFrame:
    """Presences and background in one table; columns of one side only are NULL on the other."""
    p = presences.withColumn("presence", F.lit(1))
    b = background.withColumn("presence", F.lit(0))
    return p.unionByName(b, allowMissingColumns=True)
