"""Rasters as tables of square blocks, image and terrain chips as row-major arrays.

A block row holds the pixels of one square, band-major: index = band * side^2 + y * side + x.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.arrays import finite, zscore
from ..functions.keys import order_key, uniform
from ..session import materialize
from .joins import salted_join
from .spatial import in_footprint

#: Pixels that a task pastes or resamples in one go.
CHIP_CELLS = 1 << 21
#: Pixels that a task groups to blocks.
BLOCK_CELLS = 1 << 18


def to_blocks(pixels: DataFrame, by: list[str], band: str, n_bands: int, side: int) -> DataFrame:
    """Pixel rows (`r`, `c`, band, `v`) to dense blocks; absent pixels are NULL. A block is a bounded group."""
    place = [*by, "block_row", "block_col"]
    d = pixels.select(
        *by,
        F.floor(F.col("r") / side).cast("long").alias("block_row"),
        F.floor(F.col("c") / side).cast("long").alias("block_col"),
        (F.col(band) * side * side + F.pmod("r", F.lit(side)) * side + F.pmod("c", F.lit(side))).cast("int").alias("_i"),
        F.col("v").cast("double").alias("v"),
    )
    blank = materialize(d.select(*place).distinct(), "block_places")
    n_tasks = math.ceil(blank.count() * n_bands * side * side / BLOCK_CELLS) or 1
    blank = blank.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n_bands * side * side - 1))))
    # One shuffle by block serves both groupings, and no task that reads many pixels holds all of them.
    full = d.unionByName(blank.withColumn("v", F.lit(None).cast("double"))).repartition(n_tasks, *place)
    full = full.groupBy(*place, "_i").agg(F.max("v").alias("v"))
    cells = F.array_sort(F.collect_list(F.struct("_i", "v")))
    return full.groupBy(*place).agg(F.transform(cells, lambda s: s["v"]).alias("px"))


def layer_stats(pixels: DataFrame) -> DataFrame:
    """Mean, population deviation, range and count per layer over present pixels."""
    v = F.when(finite(F.col("v")), F.col("v"))
    return pixels.groupBy("layer").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count")
    )


def block_moments(blocks: DataFrame, n_bands: int, side: int) -> DataFrame:
    """Per block and layer: `n`, mean, squared deviations `m2`, least and greatest present value; stored, they stand for the pixels."""
    plane = side * side

    def one(k: Column) -> Column:
        v = F.filter(F.slice("px", k * plane + 1, F.lit(plane)), finite)
        mean = _mean(v)
        dev = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return F.struct(k.alias("layer"), F.size(v).cast("long").alias("n"), mean.alias("mean"), dev.alias("m2"), F.array_min(v).alias("min"), F.array_max(v).alias("max"))

    parts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), one)).alias("s")
    return blocks.select("block_row", "block_col", parts).select("block_row", "block_col", "s.*").filter("n > 0")


def merge_moments(parts: DataFrame) -> DataFrame:
    """Statistics per layer from the moments of disjoint parts."""
    total = parts.groupBy("layer").agg(F.sum("n").alias("count"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m"))
    d = parts.join(total, "layer")
    dev = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m"))
    return d.groupBy("layer").agg(
        F.first("_m").alias("mean"), F.sqrt(F.sum(dev) / F.sum("n")).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n").alias("count")
    )


def footprint_stats(
    blocks: DataFrame, moments: DataFrame, tiles: DataFrame, grid: tuple[float, float, float, float], n_bands: int, side: int, buffer_deg: float = 0.01
) -> DataFrame:
    """Statistics per layer over the pixels whose centre lies in the buffered footprint of the tiles.

    Blocks that lie in one tile as a whole count with their stored `moments`; only of blocks across an edge are
    pixels read, and of no others.
    """
    x0, y0, dx, dy = grid
    wide = tiles.select(
        (F.col("minx") - buffer_deg).alias("minx"), (F.col("maxx") + buffer_deg).alias("maxx"),
        (F.col("miny") - buffer_deg).alias("miny"), (F.col("maxy") + buffer_deg).alias("maxy"),
    )
    # Pixel rows and columns whose centres a tile holds, and the blocks these fall in.
    t = wide.select(
        F.ceil((F.col("minx") - x0) / dx - 0.5).alias("c1"), F.floor((F.col("maxx") - x0) / dx - 0.5).alias("c2"),
        F.ceil((F.lit(y0) - F.col("maxy")) / dy - 0.5).alias("r1"), F.floor((F.lit(y0) - F.col("miny")) / dy - 0.5).alias("r2"),
    )
    t = t.filter("c1 <= c2 AND r1 <= r2")
    for axis, a, b in (("block_row", "r1", "r2"), ("block_col", "c1", "c2")):
        t = t.withColumn(axis, F.explode(F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side))))
    whole = F.lit(True)
    for axis, a, b in (("block_row", "r1", "r2"), ("block_col", "c1", "c2")):
        whole = whole & (F.col(a) <= F.col(axis) * side) & (F.col(b) >= F.col(axis) * side + side - 1)
    met = materialize(t.groupBy("block_row", "block_col").agg(F.bool_or(whole).alias("whole")), "footprint_blocks")
    inner = moments.join(met.filter("whole"), ["block_row", "block_col"], "left_semi")
    edge = blocks.join(met.filter("NOT whole"), ["block_row", "block_col"], "left_semi")
    at = F.col("_i") % (side * side)
    px = edge.select("block_row", "block_col", F.posexplode("px").alias("_i", "v")).filter(finite(F.col("v"))).select(
        F.floor(F.col("_i") / (side * side)).cast("int").alias("layer"), (F.col("block_row") * side + F.floor(at / side)).alias("r"),
        (F.col("block_col") * side + at % side).alias("c"), "v",
    )
    px = mask_pixels(px, tiles, F.lit(x0) + (F.col("c") + 0.5) * dx, F.lit(y0) - (F.col("r") + 0.5) * dy, buffer_deg)
    rim = px.groupBy("layer").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("_v"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    rim = rim.withColumn("m2", F.col("_v") * F.col("n")).drop("_v")
    return merge_moments(inner.drop("block_row", "block_col").unionByName(rim))


def mask_pixels(pixels: DataFrame, tiles: DataFrame, x: Column, y: Column, buffer_deg: float = 0.01) -> DataFrame:
    """Pixels whose centre (`x`, `y` in degrees) lies in the buffered footprint of the tiles."""
    wide = tiles.select(
        (F.col("minx") - buffer_deg).alias("minx"), (F.col("maxx") + buffer_deg).alias("maxx"),
        (F.col("miny") - buffer_deg).alias("miny"), (F.col("maxy") + buffer_deg).alias("maxy"),
    )
    d = pixels.withColumn("lon", x).withColumn("lat", y).withColumn("_pid", F.xxhash64("r", "c"))
    return in_footprint(d, wide, "_pid").drop("lon", "lat", "_pid")


def sample_rasters(points: DataFrame, blocks: DataFrame, grid: tuple[float, float, float, float], n_bands: int, side: int, ident: str) -> DataFrame:
    """`values`: every layer at the pixel under each point; NULL outside the raster. One join for all layers."""
    x0, y0, dx, dy = grid
    r, c = F.floor((F.lit(y0) - F.col("lat")) / dy).cast("long"), F.floor((F.col("lon") - x0) / dx).cast("long")
    p = points.withColumn("_r", r).withColumn("_c", c)
    p = p.withColumn("block_row", F.floor(F.col("_r") / side).cast("long")).withColumn("block_col", F.floor(F.col("_c") / side).cast("long"))
    p = p.withColumn("_o", (F.pmod("_r", F.lit(side)) * side + F.pmod("_c", F.lit(side))).cast("int"))
    j = salted_join(p, blocks, ["block_row", "block_col"], "left", ident)
    vals = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda k: F.get(F.col("px"), k * side * side + F.col("_o")))
    return j.withColumn("values", vals).drop("px", "block_row", "block_col", "_r", "_c", "_o")


def stats_by_layer(stats: DataFrame) -> Column:
    """Layer statistics (one row per layer) as one scalar subquery: map of layer to (mean, std)."""
    entry = F.struct(F.col("layer").cast("int"), F.struct("mean", "std"))
    return stats.agg(F.map_from_entries(F.collect_list(entry)).alias("s")).scalar()


def zscore_values(df: DataFrame, stats: DataFrame, column: str = "values") -> DataFrame:
    """Sampled layer values as z-scores; value k is layer k. A layer without usable statistics raises."""

    def score(v: Column, k: Column) -> Column:
        s = F.try_element_at(F.col("_stats"), k)
        bad = s.isNull() | F.coalesce(s["std"] <= 0, F.lit(True))
        return F.when(bad, F.raise_error(F.concat(F.lit("no usable statistics for layer "), k.cast("string"))).cast("double")).otherwise((v - s["mean"]) / s["std"])

    return df.withColumn("_stats", stats_by_layer(stats)).withColumn(column, F.transform(column, score)).drop("_stats")


# --- chips held as arrays -------------------------------------------------------------------


def _at(px: Column, band: int, plane: int, i: Column) -> Column:
    return F.get(px, i + band * plane)


def valid_pixels(px: Column, bands: int, plane: int) -> Column:
    """Positions whose value is finite in every band."""

    def ok(i: Column) -> Column:
        hit = finite(_at(px, 0, plane, i))
        for b in range(1, bands):
            hit = hit & finite(_at(px, b, plane, i))
        return hit

    return F.filter(F.sequence(F.lit(0), F.lit(plane - 1)), ok)


def valid_fraction(px: Column, bands: int, plane: int) -> Column:
    """Share of pixels finite in all bands."""
    return F.size(valid_pixels(px, bands, plane)) / F.lit(float(plane))


def image_window_valid(px: Column, bands: int, plane: int, min_share: float) -> Column:
    """Enough pixels finite in all bands and non-zero in some; a bound of 0 or less always passes."""
    if min_share <= 0:
        return F.lit(True)

    def lit_up(i: Column) -> Column:
        hit = _at(px, 0, plane, i) != 0
        for b in range(1, bands):
            hit = hit | (_at(px, b, plane, i) != 0)
        return hit

    return F.size(F.filter(valid_pixels(px, bands, plane), lit_up)) / F.lit(float(plane)) >= min_share


def normalize_bands(px: Column, plane: int, stats: list[tuple[float, float]]) -> Column:
    """Z-score per band; missing stays missing."""
    parts = [zscore(F.slice(px, b * plane + 1, plane), F.lit(m), F.lit(s)) for b, (m, s) in enumerate(stats)]
    return F.concat(*parts)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / F.nullif(F.size(a), F.lit(0))


def summarize_topo(df: DataFrame, px: str, plane: int) -> DataFrame:
    """The ten terrain scalars over pixels valid in all four bands, plus the valid share."""
    out = df.withColumn("_ok", valid_pixels(F.col(px), 4, plane))
    out = out.withColumn("topo_valid_frac", F.size("_ok") / F.lit(float(plane)))
    for b in range(4):
        out = out.withColumn(f"_b{b}", _take(F.col(px), b, plane))
    for a, name in ((F.col("_b0"), "elev"), (F.col("_b1"), "slope")):
        out = out.withColumn(f"{name}_mean", _mean(a))
        out = out.withColumn(f"{name}_sd", F.sqrt(_mean(_squares(a, F.col(f"{name}_mean")))))
        out = out.withColumn(f"{name}_min", F.array_min(a)).withColumn(f"{name}_max", F.array_max(a))
    out = out.withColumn("northness_mean", _mean(F.col("_b2"))).withColumn("eastness_mean", _mean(F.col("_b3")))
    return out.drop("_ok", "_b0", "_b1", "_b2", "_b3")


def _take(px: Column, band: int, plane: int) -> Column:
    return F.transform(F.col("_ok"), lambda i: _at(px, band, plane, i))


def _squares(a: Column, mean: Column) -> Column:
    return F.transform(a, lambda v: (v - mean) * (v - mean))


def augment_params(df: DataFrame, ident: str, seed: int, degrees: float, p_h: float, p_v: float) -> DataFrame:
    """Seeded rotation angle and mirror flags per sample; image and terrain of a sample share them."""
    k = order_key(seed, F.col(ident))
    d = df.withColumn("angle", (uniform(k, 0) * 2.0 - 1.0) * degrees)
    return d.withColumn("hflip", uniform(k, 1) < p_h).withColumn("vflip", uniform(k, 2) < p_v)


def rotate_kernel(stack: np.ndarray, angle: float) -> np.ndarray:
    """Rotate (bands, h, w) counter-clockwise about the centre, bilinear, 0 outside."""
    _, h, w = stack.shape
    t = np.deg2rad(angle)
    yy, xx = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    sx = np.cos(t) * xx - np.sin(t) * yy + (w - 1) / 2
    sy = np.sin(t) * xx + np.cos(t) * yy + (h - 1) / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros(stack.shape, dtype=float)
    for oy in (0, 1):
        for ox in (0, 1):
            x, y = x0 + ox, y0 + oy
            wgt = (1 - np.abs(sx - x)) * (1 - np.abs(sy - y))
            ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
            out += np.where(ok, wgt, 0.0) * stack[:, y.clip(0, h - 1), x.clip(0, w - 1)]
    return out


def rotate(df: DataFrame, px: str, angle: str, bands: int, h: int, w: int) -> DataFrame:
    """Rotate every chip by its own angle, in Arrow batches."""
    schema = df.schema

    def run(batches):
        for b in batches:
            b[px] = [
                rotate_kernel(np.nan_to_num(np.asarray(p, dtype=float)).reshape(bands, h, w), a).ravel()
                for p, a in zip(b[px], b[angle])
            ]
            yield b

    return df.mapInPandas(run, schema)


def augment_batch(stack: np.ndarray, angle: np.ndarray, hflip: np.ndarray, vflip: np.ndarray) -> np.ndarray:
    """Rotate (chips, bands, h, w) counter-clockwise about the centre, each by its angle, then mirror; bilinear, 0 outside."""
    n, bands, h, w = stack.shape
    t = np.deg2rad(angle)[:, None, None]
    xx = (np.arange(w) - (w - 1) / 2)[None, None, :] * np.where(hflip, -1.0, 1.0)[:, None, None]
    yy = (np.arange(h) - (h - 1) / 2)[None, :, None] * np.where(vflip, -1.0, 1.0)[:, None, None]
    sx, sy = np.cos(t) * xx - np.sin(t) * yy + (w - 1) / 2, np.sin(t) * xx + np.cos(t) * yy + (h - 1) / 2
    x0, y0 = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
    flat, out = stack.reshape(n, bands, h * w), np.zeros((n, bands, h * w))
    for oy in (0, 1):
        for ox in (0, 1):
            x, y = x0 + ox, y0 + oy
            inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
            weight = np.where(inside, (1 - np.abs(sx - x)) * (1 - np.abs(sy - y)), 0.0).reshape(n, 1, h * w)
            at = (y.clip(0, h - 1) * w + x.clip(0, w - 1)).reshape(n, 1, h * w)
            out += weight * np.take_along_axis(flat, np.broadcast_to(at, out.shape), 2)
    return out.reshape(stack.shape)


def turn_vectors(stack: np.ndarray, north: int, east: int, angle: np.ndarray, hflip: np.ndarray, vflip: np.ndarray) -> None:
    """Turn and mirror the direction that two bands hold, in place, as `augment_batch` does with the pixels."""
    t = np.deg2rad(angle)[:, None, None]
    n, e = stack[:, north].copy(), stack[:, east].copy()
    stack[:, east] = (np.cos(t) * e - np.sin(t) * n) * np.where(hflip, -1.0, 1.0)[:, None, None]
    stack[:, north] = (np.sin(t) * e + np.cos(t) * n) * np.where(vflip, -1.0, 1.0)[:, None, None]


def augment(
    df: DataFrame, ident: str, chips: dict[str, tuple[int, int, int]], seed: int, degrees: float, p_h: float, p_v: float,
    where: Column | None = None, vectors: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Rotate and mirror the chip columns of the rows that meet `where` (training rows), all chips of a row alike.

    `chips` gives bands, height and width of each column; missing pixels of a turned chip count as 0. Other rows keep
    their pixels and have no `angle`. `vectors` names the two bands (northness, eastness, before any z-score) of a
    column that hold a direction: it is turned along with the pixels. A row without a chip keeps none.
    """
    on = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    d = augment_params(df, ident, seed, degrees, p_h, p_v)
    d = d.withColumns({"angle": F.when(on, F.col("angle")), "hflip": on & F.col("hflip"), "vflip": on & F.col("vflip")})
    d = d.withColumns({c: F.col(c).cast("array<double>") for c in chips})
    turned = vectors or {}

    def run(batches):
        for b in batches:
            angle = b.column("angle").to_numpy(zero_copy_only=False)
            hf, vf = (b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("hflip", "vflip"))
            for name, (bands, h, w) in chips.items():
                size = bands * h * w
                flat, start, there = _flat(pa.chunked_array([b.column(name)]))
                values = flat[start[there][:, None] + np.arange(size)] if there.any() else np.zeros((0, size))
                rows = np.flatnonzero(there)
                todo = np.flatnonzero(~np.isnan(angle[rows]))
                for k in np.array_split(todo, max(1, len(todo) * size // CHIP_CELLS)):
                    p = [v[rows[k]] for v in (angle, hf, vf)]
                    out = augment_batch(np.nan_to_num(values[k]).reshape(len(k), bands, h, w), *p)
                    if name in turned:
                        turn_vectors(out, *turned[name], *p)
                    values[k] = out.reshape(len(k), size)
                items = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
                ends = np.concatenate([[0], np.cumsum(np.where(there, size, 0))]).astype(np.int32)
                b = b.set_column(b.schema.get_field_index(name), name, pa.ListArray.from_arrays(pa.array(ends), items, mask=pa.array(~there)))
            yield b

    return d.mapInArrow(run, d.schema)


# --- cutting chips from blocks --------------------------------------------------------------


def chip_windows(sites: DataFrame, tiles: DataFrame, size: int, bin_side: float) -> DataFrame:
    """Window of `size` pixels around each site on the grid of the first tile (by id) that holds it.

    Windows and the blocks they need are narrow rows that several joins read, so they are stored once.
    """
    t = _bins(tiles.select("tile_id", "x0", "y0", "px_size", "minx", "miny", "maxx", "maxy"), bin_side)
    p = sites.select("sample_id", "x", "y", F.floor(F.col("x") / bin_side).alias("_gx"), F.floor(F.col("y") / bin_side).alias("_gy"))
    inside = F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy"))
    hit = salted_join(p, t, ["_gx", "_gy"], "inner", "sample_id", inside)
    one = hit.groupBy("sample_id", "x", "y").agg(F.min_by(F.struct("x0", "y0", "px_size"), "tile_id").alias("g"))
    col = F.floor((F.col("x") - F.col("g.x0")) / F.col("g.px_size")) - size // 2
    row = F.floor((F.col("g.y0") - F.col("y")) / F.col("g.px_size")) - size // 2
    side = F.col("g.px_size") * size
    d = one.withColumn("left", F.col("g.x0") + col * F.col("g.px_size")).withColumn("top", F.col("g.y0") - row * F.col("g.px_size"))
    d = d.select("sample_id", "left", "top", (F.col("left") + side).alias("right"), (F.col("top") - side).alias("bottom"))
    return materialize(d, "windows")


def _bins(tiles: DataFrame, side: float) -> DataFrame:
    xs = F.sequence(F.floor(F.col("minx") / side), F.floor(F.col("maxx") / side))
    ys = F.sequence(F.floor(F.col("miny") / side), F.floor(F.col("maxy") / side))
    return tiles.withColumn("_gx", F.explode(xs)).withColumn("_gy", F.explode(ys))


def chip_window_blocks(windows: DataFrame, tiles: DataFrame, size: int, block: int, bin_side: float) -> DataFrame:
    """Blocks each window needs from each overlapping tile; windows over tiles of different CRS are refused."""
    t = _bins(tiles.select("tile_id", "crs", "x0", "y0", "px_size", "h", "w", "minx", "miny", "maxx", "maxy"), bin_side)
    wb = windows.select("*", F.col("left").alias("minx"), F.col("bottom").alias("miny"), F.col("right").alias("maxx"), F.col("top").alias("maxy"))
    wb = _bins(wb, bin_side).drop("minx", "miny", "maxx", "maxy")
    meet = (
        (F.col("left") <= F.col("maxx")) & (F.col("right") >= F.col("minx"))
        & (F.col("bottom") <= F.col("maxy")) & (F.col("top") >= F.col("miny"))
    )
    pair = salted_join(wb, t, ["_gx", "_gy"], "inner", "sample_id", meet)
    cols = ["sample_id", "left", "top", "tile_id", "crs", "x0", "y0", "px_size", "h", "w"]
    pair = materialize(pair.select(*cols).distinct(), "window_tiles")
    mixed = pair.groupBy("sample_id").agg(F.min("crs").alias("_a"), F.max("crs").alias("_b")).filter("_a = _b").select("sample_id")
    pair = pair.join(mixed, "sample_id", "left_semi")
    d = pair.withColumn("row_off", F.round((F.col("y0") - F.col("top")) / F.col("px_size")).cast("int"))
    d = d.withColumn("col_off", F.round((F.col("left") - F.col("x0")) / F.col("px_size")).cast("int"))

    def cover(off: str, dim: str) -> Column:
        lo = F.greatest(F.col(off), F.lit(0))
        hi = F.least(F.col(off) + size, F.col(dim)) - 1
        return F.when(hi >= lo, F.sequence(F.floor(lo / block), F.floor(hi / block))).otherwise(F.array().cast("array<bigint>"))

    d = d.withColumn("block_row", F.explode(cover("row_off", "h"))).withColumn("block_col", F.explode(cover("col_off", "w")))
    return materialize(d.select("sample_id", "tile_id", "row_off", "col_off", "block_row", "block_col"), "window_blocks")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of about `rows` rows that hold all rows of their keys."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        keys = t.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pixels of an array column in one run (missing ones NaN), each row's first place, and whether the row has pixels."""
    rows = column.combine_chunks()
    return rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()[:-1].astype(np.int64), rows.is_valid().to_numpy(zero_copy_only=False)


def paste_batch(t: pa.Table, size: int, block: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples and their chips (one row each) from all their blocks: of overlapping tiles the first non-zero value by id stays."""
    flat, start, _ = _flat(t.column("px"))
    sample, tile, ro, co, br, bc = (t.column(c).to_numpy().astype(np.int64) for c in ("sample_id", "tile_id", "row_off", "col_off", "block_row", "block_col"))
    ids, chip = np.unique(sample, return_inverse=True)
    y, x = br * block - ro, bc * block - co
    y1, x1 = np.maximum(y, 0), np.maximum(x, 0)
    h, w = (np.maximum(np.minimum(p + block, size) - q, 0) for p, q in ((y, y1), (x, x1)))
    # Later writes win, so tiles come in falling order and zeros are not written.
    order = np.argsort(-tile, kind="stable")
    cells = (h * w)[order]
    at = np.repeat(order, cells)
    k = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    yy, xx = y1[at] + k // w[at], x1[at] + k % w[at]
    src = start[at] + (yy - y[at]) * block + (xx - x[at])
    dst = chip[at] * (bands * size * size) + yy * size + xx
    out = np.zeros(len(ids) * bands * size * size, flat.dtype)
    for b in range(bands):
        v = np.nan_to_num(flat[src + b * block * block])
        on = v != 0
        out[dst[on] + b * size * size] = v[on]
    return ids, out.reshape(len(ids), -1)


def _chip_rows(ids: np.ndarray, chips: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    values = pa.array(chips.ravel(), mask=np.isnan(chips.ravel()) if chips.dtype.kind == "f" else None).cast(kind)
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * chips.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), values)], ["sample_id", "px"])


def assemble_chips(needed: DataFrame, blocks: DataFrame, size: int, block: int, bands: int) -> DataFrame:
    """Chips pasted from the blocks they need, many in one go, pixels in the blocks' own type. Uncovered pixels are 0.

    A task sorts its rows by sample and pastes about CHIP_CELLS cells at a time.
    """
    j = salted_join(needed, blocks, ["tile_id", "block_row", "block_col"], "inner", "sample_id")
    cols = ["sample_id", "tile_id", "row_off", "col_off", "block_row", "block_col", "px"]
    kind = blocks.schema["px"].dataType
    rows = max(16, CHIP_CELLS // (bands * block * block))

    def run(batches):
        for t in whole_groups(batches, "sample_id", rows):
            yield _chip_rows(*paste_batch(t, size, block, bands), to_arrow_type(kind.elementType))

    return j.select(*cols).repartition("sample_id").sortWithinPartitions("sample_id").mapInArrow(run, f"sample_id long, px {kind.simpleString()}")


def target_pixels(windows: DataFrame, grid: tuple[float, float, float, float], size: int) -> DataFrame:
    """Centres of a `size` x `size` grid over each window in source pixel coordinates (`u` right, `v` down)."""
    x0, y0, dx, dy = grid
    d = windows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
    ty, tx = F.floor(F.col("i") / size), F.col("i") % size
    mx = F.col("left") + (tx + 0.5) * (F.col("right") - F.col("left")) / size
    my = F.col("top") - (ty + 0.5) * (F.col("top") - F.col("bottom")) / size
    return d.select("sample_id", "i", ((mx - x0) / dx - 0.5).alias("u"), ((F.lit(y0) - my) / dy - 0.5).alias("v"))


def bilinear_neighbours(targets: DataFrame) -> DataFrame:
    """The 2 x 2 source pixels around each target with their weights."""
    d = targets.withColumn("_y", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_x", F.explode(F.array(F.lit(0), F.lit(1))))
    r, c = F.floor("v") + F.col("_y"), F.floor("u") + F.col("_x")
    d = d.withColumn("r", r.cast("long")).withColumn("c", c.cast("long"))
    wgt = (F.lit(1.0) - F.abs(F.col("u") - F.col("c"))) * (F.lit(1.0) - F.abs(F.col("v") - F.col("r")))
    return d.withColumn("weight", wgt).drop("_y", "_x", "u", "v")


def bilinear(targets: DataFrame, blocks: DataFrame, bands: int, side: int) -> DataFrame:
    """Bilinear value per target and band; weights are renormalised over valid neighbours, NULL if there is none."""
    n = bilinear_neighbours(targets).filter(F.col("weight") > 0)
    n = n.withColumn("block_row", F.floor(F.col("r") / side)).withColumn("block_col", F.floor(F.col("c") / side))
    n = n.withColumn("_o", (F.pmod("r", F.lit(side)) * side + F.pmod("c", F.lit(side))).cast("int")).drop("r", "c")
    j = salted_join(n, blocks, ["block_row", "block_col"], "left", "sample_id")
    aggs = []
    for b in range(bands):
        v = F.get(F.col("px"), F.col("_o") + b * side * side)
        w = F.when(finite(v), F.col("weight"))
        aggs.append(F.try_divide(F.sum(w * v), F.sum(w)).alias(f"b{b}"))
    return j.groupBy("sample_id", "i").agg(*aggs)


def resample_batch(t: pa.Table, size: int, side: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples and their bilinear grids from the rectangles of source blocks they need.

    Rows are sorted by sample, block row and block column, so a pixel's block is found by arithmetic; u, v run
    linearly between the corners of a window. Weights are shared among valid neighbours; NaN where there is none.
    """
    flat, start, there = _flat(t.column("px"))
    flat = np.append(flat.astype(np.float64), np.nan)
    sample, br, bc = (t.column(c).to_numpy() for c in ("sample_id", "block_row", "block_col"))
    first = np.flatnonzero(np.diff(sample, prepend=sample[0] - 1))
    r0, c0 = br[first], bc[first]
    nr, nc = np.maximum.reduceat(br, first) - r0 + 1, np.maximum.reduceat(bc, first) - c0 + 1
    u1, u2, v1, v2 = (t.column(c).to_numpy()[first][:, None] for c in ("u1", "u2", "v1", "v2"))
    step = (np.arange(size) + 0.5) / size
    u, v = u1 + step * (u2 - u1) - 0.5, v1 + step * (v2 - v1) - 0.5
    num, den = (np.zeros((len(first), bands, size, size)) for _ in range(2))
    for oy in (0, 1):
        y = np.floor(v).astype(np.int64) + oy
        row = y // side - r0[:, None]
        for ox in (0, 1):
            x = np.floor(u).astype(np.int64) + ox
            col = x // side - c0[:, None]
            w = (1 - np.abs(v - y))[:, :, None] * (1 - np.abs(u - x))[:, None, :]
            on = ((row >= 0) & (row < nr[:, None]))[:, :, None] & ((col >= 0) & (col < nc[:, None]))[:, None, :] & (w > 0)
            at = np.where(on, first[:, None, None] + (row * nc[:, None])[:, :, None] + col[:, None, :], 0)
            on &= there[at]
            src = start[at] + ((y % side) * side)[:, :, None] + (x % side)[:, None, :]
            for b in range(bands):
                val = flat[np.where(on, src + b * side * side, -1)]
                good = np.isfinite(val)
                num[:, b] += np.where(good, w * val, 0.0)
                den[:, b] += np.where(good, w, 0.0)
    with np.errstate(invalid="ignore"):
        return sample[first], np.where(den > 0, num / den, np.nan).reshape(len(first), -1)


def resample_topo(windows: DataFrame, blocks: DataFrame, grid: tuple[float, float, float, float], size: int, side: int, bands: int = 4) -> DataFrame:
    """Terrain chip of `size` x `size` over each window, many in one go from their few source blocks."""
    x0, y0, dx, dy = grid
    d = windows.withColumn("u1", (F.col("left") - x0) / dx).withColumn("u2", (F.col("right") - x0) / dx)
    d = d.withColumn("v1", (F.lit(y0) - F.col("top")) / dy).withColumn("v2", (F.lit(y0) - F.col("bottom")) / dy)

    def span(a: str, b: str) -> Column:
        return F.sequence(F.floor((F.col(a) - 1) / side), F.floor((F.col(b) + 1) / side))

    d = d.withColumn("block_row", F.explode(span("v1", "v2"))).withColumn("block_col", F.explode(span("u1", "u2")))
    d = d.select("sample_id", "u1", "u2", "v1", "v2", "block_row", "block_col")
    j = salted_join(d, blocks, ["block_row", "block_col"], "left", "sample_id")

    rows = max(16, min(CHIP_CELLS // (bands * side * side), CHIP_CELLS // (bands * size * size)))

    def run(batches):
        for t in whole_groups(batches, "sample_id", rows):
            yield _chip_rows(*resample_batch(t, size, side, bands), pa.float64())

    return j.repartition("sample_id").sortWithinPartitions("sample_id", "block_row", "block_col").mapInArrow(run, "sample_id long, px array<double>")
