"""Row-wise cleaning, predictor checks and vector assembly."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import finite, zero_fill
from ..functions.names import BASE_PREDICTORS, NEVER_PREDICTORS, TERRAIN_SCALARS
from ..functions.text import blank_to_null, to_bool, to_number


def clean_coords(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Coerce coordinates to numbers and keep plausible ones; result columns `lat`, `lon`."""
    num = lambda c: to_number(F.col(c).cast("string"))
    out = df.withColumn("_lat", num(lat)).withColumn("_lon", num(lon))
    out = out.filter(F.col("_lat").between(-90.0, 90.0) & F.col("_lon").between(-180.0, 180.0))
    return out.drop(lat, lon).withColumnsRenamed({"_lat": "lat", "_lon": "lon"})


def uncertainty_filter(df: DataFrame, column: str | None, max_m: float | None) -> DataFrame:
    """Numeric `coordinate_uncertainty_m`; with a bound keep known values within it. No column: all NULL, no filter."""
    if column is None:
        return df.withColumn("coordinate_uncertainty_m", F.lit(None).cast("double"))
    out = df.withColumn("coordinate_uncertainty_m", to_number(F.col(column).cast("string")))
    if column != "coordinate_uncertainty_m":
        out = out.drop(column)
    return out if max_m is None else out.filter(F.col("coordinate_uncertainty_m") <= max_m)


def fill_defaults(df: DataFrame, source: str | None, species: Column | str) -> DataFrame:
    """`source` with 'unknown' for missing, `species` from a column or an expression."""
    src = blank_to_null(F.col(source)) if source else F.lit(None)
    out = df.withColumn("_source", F.coalesce(src, F.lit("unknown")))
    out = out.withColumn("species", F.col(species) if isinstance(species, str) else species)
    return out.drop(*([source] if source else []), "source").withColumnRenamed("_source", "source")


def valid_env(df: DataFrame, cols: list[str], low: float = -100.0, high: float = 100.0) -> DataFrame:
    """Rows whose environmental values are all finite and plausible."""
    vals = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    return df.filter(F.forall(vals, lambda x: finite(x) & x.between(low, high)))


def env_vector(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Ordered feature vector; `usable` is false when any entry is missing or not finite."""
    vals = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    return df.withColumn(out, vals).withColumn("usable", F.forall(F.col(out), finite))


def fill_vector(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Ordered feature vector with non-finite entries set to 0."""
    return df.withColumn(out, zero_fill(F.array(*[F.col(f"`{c}`").cast("double") for c in features])))


def topo_coverage(df: DataFrame, min_share: float = 0.90, column: str = "topo_valid_frac") -> DataFrame:
    """Rows with enough valid terrain pixels."""
    return df.filter(F.coalesce(F.col(column), F.lit(0.0)) >= min_share)


def chip_exists(df: DataFrame, chips: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose chip was written."""
    return df.join(chips.select(*on).distinct(), on, "left_semi")


def error_subset(df: DataFrame) -> DataFrame:
    """Each prediction tagged with the map subsets it belongs to: its true class, and all."""
    side = F.when(F.col("true_label") == 1, "presences").when(F.col("true_label") == 0, "background")
    return df.withColumn("subset", F.explode(F.array_compact(F.array(side, F.lit("all")))))


def resolve_predictors(columns: list[str], spec: str | list[str] | None = None, terrain: bool = True) -> list[str]:
    """Ordered predictor list from a spec: auto, a list, JSON text or comma-separated text."""
    if spec is None or (isinstance(spec, str) and spec.strip().lower() == "auto"):
        wanted = BASE_PREDICTORS + (TERRAIN_SCALARS if terrain else [])
        names = [c for c in wanted if c in columns]
    elif isinstance(spec, list):
        names = [str(c) for c in spec]
    elif isinstance(spec, str) and spec.strip().startswith("["):
        names = [str(c) for c in json.loads(spec)]
    elif isinstance(spec, str):
        names = [c.strip() for c in spec.split(",") if c.strip()]
    else:
        raise TypeError(f"unsupported predictor spec: {type(spec)}")
    missing = [c for c in names if c not in columns]
    if missing:
        raise ValueError(f"predictors not in the table: {missing}")
    banned = [c for c in names if c in NEVER_PREDICTORS]
    if banned:
        raise ValueError(f"design or bookkeeping columns cannot be predictors: {banned}")
    return names


def audit_predictors(df: DataFrame, spec: str | list[str] | None = None, terrain: bool = True) -> DataFrame:
    """Per split and predictor: rows, non-finite values; plus rows whose terrain was not normalised."""
    names = resolve_predictors(df.columns, spec, terrain)
    bad = [F.count_if(~finite(F.col(f"`{c}`").cast("double"))).alias(c) for c in names]
    raw = F.count_if(~to_bool(F.col("topo_normalized"))) if "topo_normalized" in df.columns else F.lit(0).cast("long")
    agg = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), raw.alias("n_raw_terrain"), *bad)
    return agg.unpivot(["split", "n_rows", "n_raw_terrain"], [F.col(f"`{c}`") for c in names], "predictor", "n_nonfinite")
