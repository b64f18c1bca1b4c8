"""Wall-to-wall scoring of tiles: chip grid, model inputs, aggregation of passes, overlap mosaic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import finite, scale_255, zero_fill
from ..functions.geo import pixel_to_map, utm_inverse
from ..functions.names import COORD_STATS, TERRAIN_BANDS, TERRAIN_SCALARS, TERRAIN_STATS, family_inputs
from ..session import materialize
from .joins import MAX_HOT_KEYS
from .rasters import image_window_valid, normalize_bands, summarize_topo, valid_fraction, whole_groups
from .warp import PARTS, warp_table

NODATA = -9999.0
#: Squares of single chips that a task adds up.
TASK_SQUARES = 1 << 18
#: Target pixels of a warp for a task, and of one tile for one task at most.
TASK_TARGETS, PART_TARGETS = 1 << 19, 1 << 22
#: Rows of squares and tiles that a task warps in one go.
WARP_ROWS = 1 << 16


def chip_grid(tiles: DataFrame, chip: int, stride: int) -> DataFrame:
    """Upper left corners of the full chips of each tile; the right and bottom remainder is not covered."""
    fits = tiles.filter((F.col("height") >= chip) & (F.col("width") >= chip))
    d = fits.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - chip, F.lit(stride).cast("long"))))
    return d.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - chip, F.lit(stride).cast("long"))))


def _north(tiles: DataFrame) -> Column:
    """Whether a tile's zone is a northern one; tables without the column `north` hold northern tiles."""
    return F.coalesce(F.col("north"), F.lit(True)) if "north" in tiles.columns else F.lit(True)


def chip_centre(chips: DataFrame, chip: int) -> DataFrame:
    """Longitude and latitude of each chip's centre, from the tile's origin, pixel size and UTM zone (`north` false: a southern one)."""
    x, y = pixel_to_map(F.col("row") + chip / 2, F.col("col") + chip / 2, F.col("x0"), F.col("y0"), F.col("px_size"), F.col("px_size"))
    lat, lon = utm_inverse(x, y, F.col("zone"), _north(chips))
    return chips.withColumn("lat", lat).withColumn("lon", lon)


def coord_scores(df: DataFrame) -> DataFrame:
    """Coordinate z-scores with the fixed scoring constants."""
    for c, (mean, std) in COORD_STATS.items():
        df = df.withColumn(f"{c}_norm", (F.col(c) - mean) / std)
    return df


def chip_inputs(
    chips: DataFrame,
    family: str,
    features: list[str],
    plane: int,
    topo_plane: int,
    min_image: float = 0.25,
    min_topo: float = 0.90,
    normalize: bool = True,
) -> DataFrame:
    """Model inputs of each chip and why a chip is skipped: 'image', 'topo', 'env', or NULL.

    Only what the family reads is computed: `px` (8-bit image), `topo` (raw terrain), feature columns.
    Terrain is also read when a terrain scalar is a feature.
    """
    needs = family_inputs(family)
    scalars = "tabular" in needs and any(f in TERRAIN_SCALARS for f in features)
    d, why = chips, []
    if "image" in needs:
        why.append(F.when(~image_window_valid(F.col("px"), 4, plane, min_image), "image"))
        d = d.withColumn("image_input", zero_fill(scale_255(F.col("px"), clip=False)))
    if "topo" in needs or scalars:
        why.append(F.when(valid_fraction(F.col("topo"), 4, topo_plane) < min_topo, "topo"))
        if normalize:
            d = d.withColumn("topo", normalize_bands(F.col("topo"), topo_plane, [TERRAIN_STATS[b] for b in TERRAIN_BANDS]))
        if scalars:
            d = summarize_topo(d, "topo", topo_plane)
        if "topo" in needs:
            d = d.withColumn("topo_input", zero_fill(F.col("topo")))
    if "tabular" in needs:
        d = d.withColumn("features", F.array(*[F.col(f"`{f}`").cast("double") for f in features]))
        why.append(F.when(~F.forall("features", finite), "env"))
    return d.withColumn("skip_reason", F.coalesce(*why, F.lit(None).cast("string")))


def mc_aggregate(passes: DataFrame, keys: list[str], p: str = "probability") -> DataFrame:
    """Mean and population deviation over stochastic passes."""
    return passes.groupBy(*keys).agg(F.avg(p).alias("mean_p"), F.stddev_pop(p).alias("std_p"))


def overlap_mosaic(chips: DataFrame, chip: int, stride: int) -> DataFrame:
    """Mean prediction, mean deviation and chip count where chips overlap.

    Values are constant on squares of gcd(chip, stride) pixels, so squares are aggregated, not pixels. They are
    shuffled first, to as many tasks as their number asks for, so no task holds more than its share of them at once.
    `chips` are counted and then read.
    """
    g = math.gcd(chip, stride)
    n = F.sequence(F.lit(0), F.lit(chip // g - 1))
    d = chips.withColumn("_r", F.explode(n)).withColumn("_c", F.explode(n))
    d = d.withColumn("cell_row", F.floor(F.col("row") / g) + F.col("_r")).withColumn("cell_col", F.floor(F.col("col") / g) + F.col("_c"))
    n_tasks = math.ceil(chips.count() * (chip // g) ** 2 / TASK_SQUARES) or 1
    d = d.select("tile_id", "cell_row", "cell_col", "mean_p", "std_p").repartition(n_tasks, "tile_id", "cell_row", "cell_col")
    return d.groupBy("tile_id", "cell_row", "cell_col").agg(
        F.avg("mean_p").alias("prediction"), F.avg("std_p").alias("uncertainty"), F.count(F.lit(1)).alias("n_chips")
    )


def with_uncovered(mosaic: DataFrame, tiles: DataFrame, cell: int) -> DataFrame:
    """All squares of a tile; those no chip covers get the stored nodata number and count 0."""
    rows = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("height") / cell) - 1)
    cols = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("width") / cell) - 1)
    full = tiles.select("tile_id", F.explode(rows).alias("cell_row"), "width").withColumn("cell_col", F.explode(cols)).drop("width")
    # Sizes of exploded rows are underestimated, so the planner would broadcast them.
    out = full.join(mosaic.hint("merge"), ["tile_id", "cell_row", "cell_col"], "left")
    return out.fillna({"prediction": NODATA, "uncertainty": NODATA, "n_chips": 0})


def mosaic_reproject(mosaic: DataFrame, tiles: DataFrame, cell: int, res: float) -> DataFrame:
    """Bilinear warp of the mosaic to an Albers grid of `res` metres aligned to multiples of `res`.

    A tile's squares and its size and place meet in one shuffle. A task makes the target pixels of many tiles at a time, over
    their projected bounds, and looks up their 2 x 2 source pixels, so pixels become rows only with their result. Tiles with over
    PART_TARGETS target pixels and 1/4096 of all are cut into parts by target row, each with all squares. Target pixels without a
    valid neighbour are left out, and tiles that lack a size or a place.
    """
    kind = tiles.schema["tile_id"].dataType
    info = {"height": "long", "width": "long", "x0": "double", "y0": "double", "px_size": "double", "zone": "double", "north": "boolean"}
    t = tiles.withColumn("north", _north(tiles)).select("tile_id", *[F.col(c).cast(k) for c, k in info.items()]).dropna().distinct()
    t = materialize(t, "tiles")
    area = F.col("height").cast("double") * F.col("width") * F.col("px_size") * F.col("px_size") / (res * res)
    total = t.agg(F.sum(area)).first()[0] or 0.0
    bound = max(PART_TARGETS, total / MAX_HOT_KEYS)
    # Fewer than 4096 tiles can have such a share.
    large = F.broadcast(t.filter(area > bound).groupBy("tile_id").agg(F.ceil(F.max(area) / bound).cast("int").alias("_parts")))
    d = mosaic.filter("tile_id IS NOT NULL AND cell_row IS NOT NULL AND cell_col IS NOT NULL").select(
        F.col("tile_id").cast(kind), *[F.col(c).cast("long").alias(c) for c in ("cell_row", "cell_col")], *[F.col(c).cast("double").alias(c) for c in PARTS]
    )
    d = d.unionByName(t.select("tile_id", F.struct(*info).alias("_tile")), allowMissingColumns=True)
    d = d.join(large, "tile_id", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    d = d.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    n_tasks = max(math.ceil(total / TASK_TARGETS), tiles.sparkSession.sparkContext.defaultParallelism)
    # Rows of one place come in a fixed order, so the result does not depend on how they arrive.
    d = d.repartition(n_tasks, "tile_id", "_part").sortWithinPartitions("tile_id", "_part", "cell_row", "cell_col", *PARTS)

    def run(batches):
        for b in whole_groups(batches, "tile_id", WARP_ROWS):
            yield from warp_table(b, cell, res)

    return d.mapInArrow(run, f"tile_id {kind.simpleString()}, gx long, gy long, prediction double, uncertainty double")


def tile_summary(chips: DataFrame, tiles: DataFrame) -> DataFrame:
    """Processed and skipped chips per tile; a tile with an error keeps its text and status."""
    a = chips.groupBy("tile_id").agg(
        F.count_if(F.col("skip_reason").isNull()).alias("processed_chips"),
        *[F.count_if(F.col("skip_reason") == k).alias(f"skipped_{k}_chips") for k in ("image", "topo", "env")],
    )
    counts = ["processed_chips", "skipped_image_chips", "skipped_topo_chips", "skipped_env_chips"]
    err = F.col("error") if "error" in tiles.columns else F.lit(None).cast("string")
    d = tiles.select("tile_id", err.alias("error")).join(a.hint("merge"), "tile_id", "left").fillna(0, counts)
    return d.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))
