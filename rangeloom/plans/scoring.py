"""Wall-to-wall scoring of tiles into a folder, resumable: mosaic squares per run, and a log that says which count.

A run writes the squares of its tiles below a folder of its own and only then logs its tiles. Squares of a run that
died before are in no log row, so they are never read and their tiles are scored again.

Both sides of the joins grow with the tiles, and sizes of exploded rows are underestimated, so none is broadcast.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiles as t
from ..session import materialize
from ..sinks.tables import skip_finished, write_mosaic

LOG = "tile_id long, error string, processed_chips long, skipped_image_chips long, skipped_topo_chips long, skipped_env_chips long, status string, run string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All logged tiles of all runs; none where nothing was scored yet."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def tile_errors(tiles: DataFrame, grid: DataFrame, chips: DataFrame) -> DataFrame:
    """`tiles` with `error`: an unusable size, or positions of the grid that no chip was cut for."""
    gone = grid.join(chips.select("tile_id", "row", "col").hint("merge"), ["tile_id", "row", "col"], "left_anti").groupBy("tile_id").agg(F.count(F.lit(1)).alias("_gone"))
    sized = F.coalesce((F.col("height") > 0) & (F.col("width") > 0), F.lit(False))
    why = F.when(~sized, F.lit("unusable size")).when(F.col("_gone") > 0, F.concat(F.lit("chips missing: "), F.col("_gone").cast("string")))
    return tiles.join(gone.hint("merge"), "tile_id", "left").withColumn("error", why).drop("_gone")


def score_tiles(
    tiles: DataFrame, chips: DataFrame, path: str, family: str, features: list[str], scorer: Callable[[DataFrame], DataFrame],
    plane: int, topo_plane: int, chip: int, stride: int, min_image: float = 0.25, min_topo: float = 0.90,
) -> None:
    """Score the tiles that `path` has no finished result for.

    `tiles` has `tile_id, height, width`, `chips` one row per grid position (`tile_id, row, col`, what `family` reads).
    `scorer` gives `tile_id, row, col, probability` for each stochastic pass of the chips it gets. A tile with an error
    is logged with its text and is tried again by the next run; it stops no other tile. Squares that no chip covers
    are written with the nodata number.
    """
    spark, run = tiles.sparkSession, uuid.uuid4().hex
    todo = materialize(skip_finished(tiles, read_log(spark, path).filter("status = 'ok'")), "tiles")
    if todo.isEmpty():
        return
    grid = t.chip_grid(todo, chip, stride).select("tile_id", "row", "col")
    checked = materialize(tile_errors(todo, grid, chips), "checked")
    good = checked.filter("error IS NULL").drop("error")
    own = grid.join(good.select("tile_id").hint("merge"), "tile_id", "left_semi").join(chips.hint("merge"), ["tile_id", "row", "col"])
    inputs = t.chip_inputs(own, family, features, plane, topo_plane, min_image, min_topo)
    # The verdicts read every pixel, so they are found once and kept as narrow rows.
    place = ["tile_id", "row", "col"]
    judged = materialize(inputs.select(*place, "skip_reason"), "judged")
    fit = inputs.drop("skip_reason").join(judged.filter("skip_reason IS NULL").hint("merge"), place, "left_semi")
    scored = materialize(t.mc_aggregate(scorer(fit), place), "scored")
    squares = t.with_uncovered(t.overlap_mosaic(scored, chip, stride), good, math.gcd(chip, stride))
    write_mosaic(squares, f"{path}/mosaic/{run}")
    done = t.tile_summary(judged, checked).withColumn("run", F.lit(run))
    log = [f.split()[0] for f in LOG.split(", ")]
    done.select(*log).coalesce(8).write.mode("append").parquet(f"{path}/log")


def last_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per tile: its finished run, or else an error of it."""
    log = read_log(spark, path)
    rest = [c for c in log.columns if c != "tile_id"]
    best = log.groupBy("tile_id").agg(F.max_by(F.struct(*rest), F.struct("status", "run")).alias("r"))
    return best.select("tile_id", "r.*")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Mosaic squares of the finished tiles."""
    runs = last_log(spark, path).filter("status = 'ok'").select("tile_id", "run")
    try:
        d = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/mosaic")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        schema = "tile_id long, cell_row long, cell_col long, prediction double, uncertainty double, n_chips long"
        return spark.createDataFrame([], schema)
    d = d.withColumn("run", F.regexp_extract("_metadata.file_path", "/mosaic/([0-9a-f]{32})/", 1))
    return d.join(runs.hint("merge"), ["tile_id", "run"], "left_semi").drop("run")
