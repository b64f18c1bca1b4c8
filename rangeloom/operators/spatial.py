"""Tile lookups by small degree bins, footprint tests and the area of a sampling zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import edge_meets_box, point_in_edges
from ..functions.text import base_name
from ..session import materialize
from .joins import salted_join, same_keys_join

# Side of a lookup bin in degrees; tiles cover a bounded number of bins.
BIN_DEG = 1 / 16


def _point_bins(points: DataFrame) -> DataFrame:
    return points.withColumn("_gx", F.floor(F.col("lon") / BIN_DEG)).withColumn("_gy", F.floor(F.col("lat") / BIN_DEG))


def tile_bins(tiles: DataFrame) -> DataFrame:
    """One row per lookup bin a tile's box touches."""
    xs = F.sequence(F.floor(F.col("minx") / BIN_DEG), F.floor(F.col("maxx") / BIN_DEG))
    ys = F.sequence(F.floor(F.col("miny") / BIN_DEG), F.floor(F.col("maxy") / BIN_DEG))
    return tiles.withColumn("_gx", F.explode(xs)).withColumn("_gy", F.explode(ys))


def attach_tile(points: DataFrame, tiles: DataFrame, ident: str) -> DataFrame:
    """Tile strictly containing each point (smallest id where tiles overlap); points outside all tiles stay."""
    t = tile_bins(tiles.select("tile_id", "filename", "url", "minx", "miny", "maxx", "maxy"))
    inside = (F.col("lon") > F.col("minx")) & (F.col("lon") < F.col("maxx")) & (F.col("lat") > F.col("miny")) & (F.col("lat") < F.col("maxy"))
    hit = salted_join(_point_bins(points).select(ident, "lat", "lon", "_gx", "_gy"), t, ["_gx", "_gy"], "inner", ident, inside)
    one = hit.groupBy(ident).agg(F.min_by(F.struct("tile_id", "filename", "url"), "tile_id").alias("_t")).select(ident, "_t.*")
    return points.join(one, ident, "left")


def in_footprint(points: DataFrame, tiles: DataFrame, ident: str) -> DataFrame:
    """Points inside or on the border of at least one tile; no union geometry is built."""
    t = tile_bins(tiles.select("minx", "miny", "maxx", "maxy"))
    cond = F.col("lon").between(F.col("minx"), F.col("maxx")) & F.col("lat").between(F.col("miny"), F.col("maxy"))
    return salted_join(_point_bins(points), t, ["_gx", "_gy"], "left_semi", ident, cond).drop("_gx", "_gy")


def ring_cover(edges: DataFrame, ident: str = "tile_id", side: float = 1 / 4, depth: int = 3) -> DataFrame:
    """Cells that cover shapes given by their edges (`ident, ax, ay, bx, by`; rings, holes and parts together).

    A cell that no edge touches is inside as a whole or left out; one that is touched is cut into four, `depth`
    times. Rows `ident, level, gx, gy, edges`: cell `gx, gy` of side `side` / 2^level; `edges` are those of the shape
    where a point of the cell has still to be tested, NULL where all its points are inside. Coarse cells settle the
    inner area, so the rows grow with a shape's outline. The edges of a shape are a bounded group.
    """
    edge = F.struct(*[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])
    shapes = edges.groupBy(ident).agg(F.collect_list(edge).alias("edges"), *[f(F.least(a, b) if f is F.min else F.greatest(a, b)).alias(f"{n}{a[1]}") for f, n in ((F.min, "lo"), (F.max, "hi")) for a, b in (("ax", "bx"), ("ay", "by"))])
    span = lambda d: F.explode(F.sequence(F.floor(F.col(f"lo{d}") / side), F.floor(F.col(f"hi{d}") / side)))
    cells = shapes.withColumn("gx", span("x")).withColumn("gy", span("y")).select(ident, "edges", F.col("edges").alias("near"), "gx", "gy")
    done = None
    for level in range(depth + 1):
        s = F.lit(side / 2**level)
        x0, y0 = F.col("gx") * s, F.col("gy") * s
        cells = cells.withColumn("near", F.filter("near", lambda e: edge_meets_box(e, x0, y0, s)))  # noqa: B023
        cells = materialize(cells.withColumn("open", F.size("near") > 0), "cover")
        inner = cells.filter(~F.col("open") & point_in_edges(x0 + s / 2, y0 + s / 2, F.col("edges"))).withColumn("edges", F.lit(None).cast(cells.schema["edges"].dataType))
        out = inner if level < depth else inner.unionByName(cells.filter("open"))
        out = out.select(ident, F.lit(level).alias("level"), "gx", "gy", "edges")
        done = out if done is None else done.unionByName(out)
        half = F.array(F.lit(0), F.lit(1))
        cells = cells.filter("open").drop("open").withColumn("_x", F.explode(half)).withColumn("_y", F.explode(half))
        cells = cells.withColumn("gx", F.col("gx") * 2 + F.col("_x")).withColumn("gy", F.col("gy") * 2 + F.col("_y")).drop("_x", "_y")
    return materialize(done.withColumn("side", F.lit(float(side))), "ring_cover")


def _cover_hits(points: DataFrame, cover: DataFrame, ident: str, how: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """Points joined to the cells that hold them, one probe for each level of the cover."""
    levels = [r["level"] for r in cover.select("level").distinct().collect()]  # depth + 1 at most
    side = cover.select(F.max("side")).scalar()
    probes = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)]))) if levels else points.withColumn("level", F.lit(0)).limit(0)
    size = F.pow(F.lit(2.0), F.col("level")) / side
    probes = probes.withColumn("gx", F.floor(F.col(x) * size)).withColumn("gy", F.floor(F.col(y) * size))
    inside = F.col("edges").isNull() | point_in_edges(F.col(x), F.col(y), F.col("edges"))
    return salted_join(probes, cover.drop("side"), ["level", "gx", "gy"], how, ident, inside).drop("level", "gx", "gy")


def attach_ring_tile(points: DataFrame, tiles: DataFrame, cover: DataFrame, ident: str) -> DataFrame:
    """Tile whose outline (holes excepted) holds each point, the smallest id where several do; points outside all stay."""
    hit = _cover_hits(points.select(ident, "lat", "lon"), cover, ident, "inner").groupBy(ident).agg(F.min("tile_id").alias("tile_id"))
    return points.join(hit.join(tiles.select("tile_id", "filename", "url"), "tile_id"), ident, "left")


def in_ring_footprint(points: DataFrame, cover: DataFrame, ident: str) -> DataFrame:
    """Points inside at least one outline; no union geometry is built."""
    held = _cover_hits(points.select(ident, "lat", "lon"), cover, ident, "inner").select(ident).distinct()
    return points.join(held, ident, "left_semi")


def tile_downloaded(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """Flag tiles whose base name has a stored file; `files` has a `path` column."""
    have = files.select(F.lower(base_name(F.col("path"))).alias("filename_lower")).distinct().withColumn("_have", F.lit(True))
    d = tiles.withColumn("filename", base_name(F.col("filename"))).withColumn("filename_lower", F.lower("filename"))
    return d.join(have, "filename_lower", "left").withColumn("downloaded", F.coalesce("_have", F.lit(False))).drop("_have")


def downloaded_tiles(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """Tiles with a stored file; an index with none raises."""
    out = tile_downloaded(tiles, files).filter("downloaded")
    if out.isEmpty():
        raise RuntimeError("no tile of the index has a stored file")
    return out


def row_intervals(presences: DataFrame, by: list[str], radius: float, step_m: float, strict: bool = False) -> DataFrame:
    """Per lattice row `gy` the intervals `lo..hi` of columns whose cell centres lie within `radius` of a presence, not merged.

    A presence makes a row for each lattice row it reaches, not for each cell. Intervals that start alike are one,
    so a row of the lattice has as many as it has columns at most, however many presences there are.
    """
    reach = int(radius // step_m) + 1
    d = presences.select(*by, "x", "y", F.explode(F.sequence(F.floor(F.col("y") / step_m) - reach, F.floor(F.col("y") / step_m) + reach)).alias("gy"))
    dy = (F.col("gy") + 0.5) * step_m - F.col("y")
    d = d.withColumn("_rest", F.lit(radius * radius) - dy * dy).filter("_rest >= 0")
    half = F.sqrt("_rest")
    left, right = (F.col("x") - half) / step_m - 0.5, (F.col("x") + half) / step_m - 0.5
    # Cells exactly on the circle count unless `strict`.
    lo, hi = (F.floor(left) + 1, F.ceil(right) - 1) if strict else (F.ceil(left), F.floor(right))
    d = d.select(*by, "gy", lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")
    return d.groupBy(*by, "gy", "lo").agg(F.max("hi").alias("hi"))


def covered_cells(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Cells of the union of the intervals per group: each adds what reaches past all that start before it."""
    w = W.partitionBy(*by, "gy").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    past = F.greatest(F.col("lo") - 1, F.coalesce(F.max("hi").over(w), F.col("lo") - 1))
    return intervals.withColumn("_new", F.greatest(F.col("hi") - past, F.lit(0))).groupBy(*by).agg(F.sum("_new").alias("cells"))


def sampling_area_km2(presences: DataFrame, by: list[str], inner_m: float, outer_m: float, step_m: float) -> DataFrame:
    """Area of the zone between two radii: lattice cells whose centre lies within the outer radius of some presence and
    not closer than the inner one to any, as the cells of the wide union less those of the narrow one within it."""
    wide = covered_cells(row_intervals(presences, by, outer_m, step_m), by)
    narrow = covered_cells(row_intervals(presences, by, inner_m, step_m, strict=True), by).withColumnRenamed("cells", "_inner")
    both = same_keys_join(wide, narrow, by, "left")
    return both.select(*by, ((F.col("cells") - F.coalesce("_inner", F.lit(0))) * (step_m / 1000.0) ** 2).alias("area_km2"))
