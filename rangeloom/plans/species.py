"""The whole flow for every species at once: points, splits, folds and the model-ready table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import clamp_unit, finite
from ..functions.keys import order_key
from ..functions.names import CLIMATE, ENVIRONMENT, TERRAIN_BANDS, TERRAIN_STATS
from ..operators import clean, rasters, sampling, spatial, splits
from ..operators.ranks import exact_rank
from ..session import materialize
from ..sinks import tables

BY = ["species"]


class ChipPlan(NamedTuple):
    """How chips are cut: side, block side, bands and lookup bin of the images; grid, block side and chip side of the terrain."""

    size: int
    block: int
    bands: int
    bin_side: float
    topo_grid: tuple[float, float, float, float]
    topo_block: int
    topo_size: int


def extract_chips(points: DataFrame, tiles: DataFrame, images: DataFrame, terrain: DataFrame, plan: ChipPlan) -> tuple[DataFrame, DataFrame]:
    """Image chips (`site_id, px`) and terrain chips (`site_id, px`, ten scalars, valid share) of all sites of the points.

    `points` have `site_id, x, y` in the images' system; points of one site share its chips, which are cut once.
    `images` and `terrain` are block tables. A site outside all tiles, or over tiles of two systems, has no chip, and
    terrain is only cut where there is one. Terrain chips are normalised before they are summarised.
    """
    sites = points.select(F.col("site_id").alias("sample_id"), "x", "y").dropDuplicates(["sample_id"])
    windows = rasters.chip_windows(sites, tiles, plan.size, plan.bin_side)
    need = rasters.chip_window_blocks(windows, tiles, plan.size, plan.block, plan.bin_side)
    chips = materialize(rasters.assemble_chips(need, images, plan.size, plan.block, plan.bands), "chips")
    cut = rasters.resample_topo(windows.join(chips.select("sample_id"), "sample_id", "left_semi"), terrain, plan.topo_grid, plan.topo_size, plan.topo_block)
    plane = plan.topo_size**2
    scaled = rasters.normalize_bands(F.col("px"), plane, [TERRAIN_STATS[b] for b in TERRAIN_BANDS])
    topo = materialize(rasters.summarize_topo(cut.withColumn("px", scaled), "px", plane), "topo_chips")
    return chips.withColumnRenamed("sample_id", "site_id"), topo.withColumnRenamed("sample_id", "site_id")


def presence_background(
    occurrences: DataFrame,
    tiles: DataFrame,
    grid: sampling.Grid,
    outer_km: float,
    inner_km: float,
    thin_m: float,
    mode: str = "radial",
    seed: int = 42,
    multiplier: float = 3.0,
    cap: int | None = None,
) -> DataFrame:
    """Thinned presences with background, tile names and distance thinning, per species.

    `occurrences`: `occ_id, species, source, lat, lon, coordinate_uncertainty_m`.
    """
    occ = occurrences.withColumn("order_key", order_key(seed, F.col("occ_id")))
    pres = sampling.thin_to_cell(sampling.dedup_latlon(occ, BY, "order_key"), grid, BY, "order_key")
    if cap is not None:
        pres = sampling.cap_presences(pres, cap, BY, "order_key")
    pres = materialize(pres, "thinned")
    if mode == "polygon":
        have = tiles.filter("downloaded")
        bg = sampling.background_polygon(
            pres, BY, "order_key", grid, outer_km, inner_km, multiplier, seed=seed,
            footprint=lambda p: spatial.in_footprint(p, have, "draw_key"),
        )
    else:
        bg = sampling.background_radial(pres, BY, "order_key", grid, outer_km, inner_km, multiplier, seed=seed)
    keep = ["species", "source", "lat", "lon", "cell_row", "cell_col"]
    p = pres.select(*keep, "coordinate_uncertainty_m", F.concat(F.lit("p"), F.col("occ_id")).alias("point_id"))
    b = bg.select(*keep, "nearest_presence_km", "background_sampling_rule", F.concat(F.lit("b"), F.col("draw_key")).alias("point_id"))
    pts = splits.union_points(p, b)
    pts = spatial.attach_tile(pts, tiles, "point_id").withColumn("point_key", order_key(seed, F.col("point_id")))
    pts = materialize(sampling.with_albers(sampling.dedup_points(pts, BY, "point_key")), "points")
    return materialize(sampling.spatial_thin(pts, BY, "point_id", "point_key", thin_m), "thinned_points")


def designs(points: DataFrame, train: float, val: float, block_m: float, k: int, seed: int = 42) -> DataFrame:
    """Uniform split and k spatial rounds of the same points: a row a point, its splits as an array `rounds` of (design, round, split).

    Points travel once through every step, whatever the number of rounds; `each_round` gives the rows of all rounds.
    """
    u = splits.stratified_split(points, BY, "point_key", train, val).withColumnRenamed("split", "_uniform")
    f = splits.assign_folds(splits.spatial_blocks(u, BY, block_m), BY, k, seed)
    d = splits.cv_labels(materialize(f, "folds"), BY, "point_key", k, out="_cv")
    entry = lambda design, cv_round, split: F.struct(F.lit(design).alias("design"), cv_round.alias("cv_round"), split.alias("split"))
    cv = F.transform("_cv", lambda s, i: entry("spatial_cv", i + 1, s))
    return d.withColumn("rounds", F.concat(F.array(entry("uniform", F.lit(0), F.col("_uniform"))), cv)).drop("_uniform", "_cv")


def each_round(points: DataFrame) -> DataFrame:
    """One row for each point and entry of its `rounds`; a uniform split knows no folds and blocks."""
    d = points.select("*", F.inline("rounds")).drop("rounds")
    spatial = F.col("design") == "spatial_cv"
    return d.withColumns({c: F.when(spatial, F.col(c)) for c in ("block_x", "block_y", "block_id", "fold")})


def extract_environment(
    points: DataFrame, blocks: DataFrame, grid: tuple[float, float, float, float], side: int, stats: DataFrame, without: tuple[str, ...] = ()
) -> DataFrame:
    """Climate z-scores and the bounded modification index at each point; implausible rows are dropped.

    `blocks` hold the 19 climate layers and the index as layer 19; `stats` has the 19 climate rows. Columns named by
    `without` neither travel to the blocks nor come back.
    """
    d = rasters.sample_rasters(points, blocks, grid, len(ENVIRONMENT), side, "point_id").drop(*without)
    d = d.withColumn("ghm", clamp_unit(F.col("values")[len(CLIMATE)])).withColumn("values", F.slice("values", 1, len(CLIMATE)))
    d = rasters.zscore_values(d, stats)
    # The test runs on the arrays and the result is stored once per point: testing twenty derived
    # columns would repeat the array arithmetic in each of them.
    ok = F.forall(F.array_append("values", F.col("ghm")), lambda x: finite(x) & x.between(-100.0, 100.0))
    d = materialize(d.withColumn("_ok", ok), "environment").filter("_ok").drop("_ok")
    return d.select("*", *[F.col("values")[k].alias(c) for k, c in enumerate(CLIMATE)]).drop("values")


def build_dataset(
    points: DataFrame,
    design_points: DataFrame,
    chips: DataFrame,
    topo: DataFrame,
    env_blocks: DataFrame,
    env_grid: tuple[float, float, float, float],
    side: int,
    env_stats: DataFrame,
    min_topo: float = 0.90,
) -> DataFrame:
    """Model-ready rows: everything is read once per point, then joined to its splits.

    `points` have a `site_id`; `design_points` are those of `designs`, `chips` and `topo` those of `extract_chips`. A point
    without an image chip, usable climate values or enough terrain is left out. A point appears in every round but is
    extracted, normalised and ranked once, since all rounds of a species hold the same points; it is repeated at the very
    end. Pixels stay in the chip tables, which the rows name by `site_id`.
    """
    seen = clean.chip_exists(points.select("point_id", "site_id", "lat", "lon"), chips, ["site_id"])
    terrain = clean.topo_coverage(topo.drop("px"), min_topo)
    covered = seen.join(terrain.select("site_id"), "site_id", "left_semi")
    ready = extract_environment(covered, env_blocks, env_grid, side, env_stats, ("lat", "lon"))
    # A site's terrain comes last, so it does not travel with the points.
    data = materialize(design_points.drop("site_id").join(ready, "point_id").join(terrain, "site_id"), "dataset")
    ranked = exact_rank(splits.norm_latlon(data, BY), BY, "point_key", "_rk")
    return splits.sample_names(each_round(ranked))


def write_species(
    points: DataFrame,
    design_points: DataFrame,
    tiles: DataFrame,
    images: DataFrame,
    terrain: DataFrame,
    plan: ChipPlan,
    env_blocks: DataFrame,
    env_grid: tuple[float, float, float, float],
    side: int,
    env_stats: DataFrame,
    path: str,
    min_topo: float = 0.90,
) -> None:
    """The end of the flow: tables `dataset` (by species, design, round and split), `images` and `topo_chips` below `path`."""
    chips, topo = extract_chips(points, tiles, images, terrain, plan)
    data = build_dataset(points, design_points, chips, topo, env_blocks, env_grid, side, env_stats, min_topo)
    tables.write_table(data, f"{path}/dataset", "dataset")
    used = materialize(data.select("site_id").distinct(), "used_sites")
    for name, df in (("images", chips), ("topo_chips", topo.select("site_id", "px"))):
        df.join(used, "site_id", "left_semi").write.mode("errorifexists").parquet(f"{path}/{name}")
