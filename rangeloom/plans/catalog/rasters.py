"""Raster, chip and tile queries (J6-J8, J13, J14, R*, T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import arrays
from ...functions.names import TERRAIN_BANDS, TERRAIN_STATS
from ...operators import rasters as r
from ...operators import tiles as t
from ...session import materialize
from ..registry import Inputs, query
from .cleaning import utm_forward_sql
from .common import albers_inverse_sql, albers_sql, rnd

ENV_GRID = (-130.0, 50.0, 1 / 8, 1 / 8)
TOPO_GRID = (0.0, 0.0, 0.8, 1.0)


def chip_rows(i: Inputs):
    """One row per chip with its 64 pixel values; every 29th is missing."""
    px = F.transform(
        "embedding",
        lambda e, k: F.when((F.col("vec_id") + k) % 29 != 0, F.floor(F.abs(e.cast("double")) * 1000).cast("double")),
    )
    return i.embeddings.select("vec_id", px.alias("px"))


def pixels(chips, arr):
    """Chip arrays back to pixel rows (band, y, x, v)."""
    d = chips.select("vec_id", F.posexplode(arr).alias("i", "v"))
    return d.select(
        "vec_id", F.floor(F.col("i") / 16).alias("band"), F.floor(F.col("i") % 16 / 4).alias("y"),
        (F.col("i") % 4).cast("long").alias("x"), "v",
    )


def env_blocks(i: Inputs):
    """The climate raster as 16 x 16 blocks of 20 layers."""
    return materialize(r.to_blocks(i.env_pixel, [], "layer", 20, 16), "env_blocks")


_ENV_AT = """e AS (SELECT o.occ_id, p.layer, p.v FROM occ o JOIN env_pixel p ON p.r = CAST(floor((50 - o.lat) * 8) AS BIGINT) AND p.c = CAST(floor((o.lon + 130) * 8) AS BIGINT))"""


@query(
    "J6_sample_rasters", ["occ", "env_pixel"],
    f"WITH {_ENV_AT} SELECT occ_id, count(v) AS n_known, round(sum(v * (layer + 1)), 6) AS checksum, max(v) FILTER (layer = 7) AS layer_7 FROM e GROUP BY occ_id",
)
def sample_rasters(i: Inputs):
    d = r.sample_rasters(i.occ, env_blocks(i), ENV_GRID, 20, 16, "occ_id")
    v = F.col("values")
    total = F.aggregate(F.transform(v, lambda x, k: F.coalesce(x * (k + 1), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return d.select(
        "occ_id", F.size(F.filter(v, lambda x: x.isNotNull())).cast("long").alias("n_known"), rnd(total, 6, "checksum"), v[7].alias("layer_7")
    )


@query(
    "S6_raster_blocks", ["env_pixel"],
    "SELECT CAST(floor(r / 16) AS BIGINT) AS block_row, CAST(floor(c / 16) AS BIGINT) AS block_col, count(v) AS n_known, round(sum(v), 6) AS total FROM env_pixel GROUP BY 1, 2",
)
def raster_blocks(i: Inputs):
    from ...sources.rasters import read_blocks, write_blocks
    from ...session import scratch_path

    path = scratch_path(i.spark, "blocks")
    write_blocks(env_blocks(i), path)
    known = F.filter("px", lambda x: x.isNotNull())
    d = read_blocks(i.spark, path)
    return d.select("block_row", "block_col", F.size(known).cast("long").alias("n_known"), rnd(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), 6, "total"))


@query(
    "S6_block_window", ["env_pixel"],
    """SELECT CAST(floor(r / 4) AS BIGINT) AS block_row, CAST(floor(c / 4) AS BIGINT) AS block_col, count(v) AS n_known, round(coalesce(sum(v), 0), 6) AS total FROM env_pixel
 WHERE floor(r / 4) BETWEEN 12 AND 30 AND floor(c / 4) BETWEEN 40 AND 70 GROUP BY 1, 2""",
)
def block_window(i: Inputs):
    from ...sources.rasters import read_blocks, write_blocks
    from ...session import scratch_path

    path = scratch_path(i.spark, "blocks")
    write_blocks(r.to_blocks(i.env_pixel, [], "layer", 20, 4), path)
    known = F.filter("px", lambda x: x.isNotNull())
    d = read_blocks(i.spark, path, (12, 30), (40, 70))
    return d.select("block_row", "block_col", F.size(known).cast("long").alias("n_known"), rnd(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), 6, "total"))


@query(
    "R1_layer_stats", ["env_pixel"],
    'SELECT layer, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, count(v) AS "count" FROM env_pixel GROUP BY layer',
)
def layer_stats(i: Inputs):
    return r.layer_stats(i.env_pixel).select("layer", rnd("mean"), rnd("std"), "min", "max", "count")


@query(
    "R1_footprint_stats", ["env_pixel", "tile_idx"],
    """SELECT concat('v', layer) AS var, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, count(v) AS "count" FROM env_pixel
 WHERE EXISTS (SELECT 1 FROM tile_idx WHERE downloaded AND -130 + (c + 0.5) / 8 BETWEEN minx - 0.01 AND maxx + 0.01 AND 50 - (r + 0.5) / 8 BETWEEN miny - 0.01 AND maxy + 0.01) GROUP BY layer""",
)
def footprint_stats(i: Inputs):
    from ...session import scratch_path
    from ...sources import stats

    # Blocks of 4 x 4 pixels, so that some lie in a half-degree tile as a whole.
    path, names = scratch_path(i.spark, "layer_stats"), [f"v{k}" for k in range(20)]
    blocks = materialize(r.to_blocks(i.env_pixel, [], "layer", 20, 4), "env_blocks")
    moments = materialize(r.block_moments(blocks, 20, 4), "moments")

    def compute():
        d = r.footprint_stats(blocks, moments, i.tile_idx.filter("downloaded"), ENV_GRID, 20, 4)
        return d.withColumn("var", F.concat(F.lit("v"), "layer")).drop("layer")

    stats.stored_stats(i.spark, path, names, compute, "worldclim_stats")
    # The second call finds them stored.
    return stats.stored_stats(i.spark, path, names, compute).select("var", rnd("mean"), rnd("std"), "min", "max", "count")


@query(
    "J13_mask_pixels", ["env_pixel", "tile_idx"],
    """SELECT r, c, layer, v FROM env_pixel WHERE EXISTS (SELECT 1 FROM tile_idx WHERE downloaded AND -130 + (c + 0.5) / 8 BETWEEN minx - 0.01 AND maxx + 0.01 AND 50 - (r + 0.5) / 8 BETWEEN miny - 0.01 AND maxy + 0.01)""",
)
def mask_pixels(i: Inputs):
    x, y = F.lit(-130.0) + (F.col("c") + 0.5) / 8, F.lit(50.0) - (F.col("r") + 0.5) / 8
    return r.mask_pixels(i.env_pixel, i.tile_idx.filter("downloaded"), x, y).select("r", "c", "layer", "v")


@query(
    "J14_apply_stats", ["occ", "env_pixel"],
    f"""WITH {_ENV_AT}, s AS (SELECT layer, avg(v) AS m, stddev_pop(v) AS d FROM env_pixel GROUP BY layer)
 SELECT occ_id, CAST(layer AS INTEGER) AS layer, round((v - m) / d, 6) AS z FROM e JOIN s USING (layer) WHERE v IS NOT NULL""",
)
def apply_stats(i: Inputs):
    d = r.sample_rasters(i.occ, env_blocks(i), ENV_GRID, 20, 16, "occ_id")
    z = r.zscore_values(d, r.layer_stats(i.env_pixel))
    return z.select("occ_id", F.posexplode("values").alias("layer", "z")).filter("z IS NOT NULL").select("occ_id", "layer", rnd("z"))


@query("R2_zscore_layer", ["chip_pixel"], "SELECT vec_id, band, y, x, round((v - 100) / 40.0, 6) AS v FROM chip_pixel")
def zscore_layer(i: Inputs):
    d = pixels(chip_rows(i), arrays.zscore(F.col("px"), F.lit(100.0), F.lit(40.0)))
    return d.withColumn("v", F.round("v", 6))


@query("R3_clamp_ghm", ["env_pixel"], "SELECT layer, r, c, CASE WHEN v IS NOT NULL THEN least(greatest(v / 100 - 0.1, 0), 1) END AS v FROM env_pixel")
def clamp_ghm(i: Inputs):
    return i.env_pixel.select("layer", "r", "c", arrays.clamp_unit(F.col("v") / 100 - 0.1).alias("v"))


@query("R4_nodata_to_null", ["chip_pixel"], "SELECT vec_id, band, y, x, nullif(v, 7) AS v FROM chip_pixel")
def nodata_to_null(i: Inputs):
    return pixels(chip_rows(i), arrays.nodata_to_null(F.col("px"), F.lit(7.0)))


_WIN = """WITH g AS (SELECT s.*, t.x0 AS gx0, t.y0 AS gy0, row_number() OVER (PARTITION BY sample_id ORDER BY t.tile_id) AS k FROM site s JOIN img_tile t ON s.x BETWEEN t.minx AND t.maxx AND s.y BETWEEN t.miny AND t.maxy),
 win AS (SELECT sample_id, gx0 + floor(x - gx0) - 4 AS l, gy0 - (floor(gy0 - y) - 4) AS tp FROM g WHERE k = 1),
 ov AS (SELECT sample_id, l, tp, tile_id, crs, x0, y0 FROM win JOIN img_tile t ON l <= maxx AND l + 8 >= minx AND tp - 8 <= maxy AND tp >= miny),
 okc AS (SELECT sample_id FROM ov GROUP BY sample_id HAVING count(DISTINCT crs) = 1),
 pair AS (SELECT ov.*, CAST(y0 - tp AS BIGINT) AS ro, CAST(l - x0 AS BIGINT) AS co FROM ov JOIN okc USING (sample_id))
"""


def windows(i: Inputs):
    """8 x 8 windows around the sites."""
    return r.chip_windows(i.site, i.img_tile, 8, 16.0)


def image_blocks(i: Inputs):
    """Image tiles as blocks of 4 x 4 pixels of 4 bands, stored as small integers like the images are."""
    return r.to_blocks(i.img_pixel, ["tile_id"], "band", 4, 4).withColumn("px", F.col("px").cast("array<smallint>"))


def topo_blocks(i: Inputs):
    """The terrain raster as blocks of 4 x 4 pixels of 4 bands."""
    return r.to_blocks(i.topo_pixel, [], "band", 4, 4)


def needed_blocks(i: Inputs):
    """Blocks of 4 x 4 pixels the windows need."""
    return r.chip_window_blocks(windows(i), i.img_tile, 8, 4, 16.0)


@query(
    "J7_chip_window_blocks", ["img_tile", "site"],
    _WIN + """, b AS (SELECT *, unnest(range(5)) AS br FROM pair), bb AS (SELECT *, unnest(range(5)) AS bc FROM b)
 SELECT sample_id, tile_id, CAST(ro AS INTEGER) AS row_off, CAST(co AS INTEGER) AS col_off, br AS block_row, bc AS block_col FROM bb
 WHERE br * 4 < ro + 8 AND br * 4 + 4 > ro AND bc * 4 < co + 8 AND bc * 4 + 4 > co""",
)
def chip_window_blocks(i: Inputs):
    return needed_blocks(i)


@query(
    "R5_assemble_chip", ["img_tile", "img_pixel", "site"],
    _WIN + """, hit AS (SELECT sample_id, band, r - ro AS y, c - co AS x, first(v ORDER BY tile_id) FILTER (v <> 0) AS v FROM pair JOIN img_pixel p USING (tile_id)
   WHERE r >= ro AND r < ro + 8 AND c >= co AND c < co + 8 GROUP BY 1, 2, 3, 4)
 SELECT o.sample_id, b.band * 64 + h.y * 8 + h.x AS i, v FROM (SELECT DISTINCT sample_id FROM pair) o JOIN hit h USING (sample_id) JOIN (SELECT unnest(range(4)) AS band) b USING (band) WHERE v IS NOT NULL""",
)
def assemble_chip(i: Inputs):
    d = r.assemble_chips(needed_blocks(i), image_blocks(i), 8, 4, 4)
    return d.select("sample_id", F.posexplode("px").alias("i", "v")).filter("v <> 0").select("sample_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))


_TOPO = """, tg AS (SELECT sample_id, l, tp, unnest(range(16)) AS i FROM win),
 uv AS (SELECT sample_id, i, (l + (i % 4 + 0.5) * 8 / 4) / 0.8 - 0.5 AS u, (0 - (tp - (floor(i / 4) + 0.5) * 8 / 4)) / 1.0 - 0.5 AS v FROM tg),
 nb AS (SELECT *, CAST(floor(v) AS BIGINT) + oy AS r, CAST(floor(u) AS BIGINT) + ox AS c FROM uv, (VALUES (0),(1)) o(ox), (VALUES (0),(1)) q(oy)),
 wt AS (SELECT sample_id, i, r, c, (1 - abs(u - c)) * (1 - abs(v - r)) AS w FROM nb)
"""


@query("J8_bilinear_neighbours", ["img_tile", "site"], _WIN + _TOPO + "SELECT sample_id, CAST(i AS INTEGER) AS i, r, c, round(w, 6) AS weight FROM wt")
def bilinear_neighbours(i: Inputs):
    d = r.bilinear_neighbours(r.target_pixels(windows(i), TOPO_GRID, 4))
    return d.select("sample_id", "i", "r", "c", rnd("weight"))


_RESAMPLED = (
    _WIN + _TOPO
    + """, m AS (SELECT sample_id, i, band, sum(w * p.v) / sum(w) FILTER (p.v IS NOT NULL) AS v FROM wt JOIN topo_pixel p ON p.r = wt.r AND p.c = wt.c WHERE w > 0 GROUP BY 1, 2, 3)
"""
)


@query("R6_resample_topo", ["img_tile", "site", "topo_pixel"], _RESAMPLED + "SELECT sample_id, band * 16 + i AS i, round(v, 5) AS v FROM m WHERE v IS NOT NULL")
def resample_topo(i: Inputs):
    blocks = r.to_blocks(i.topo_pixel, [], "band", 4, 4)
    d = r.resample_topo(windows(i), blocks, TOPO_GRID, 4, 4)
    d = d.select("sample_id", F.posexplode("px").alias("i", "v")).filter("v IS NOT NULL")
    return d.select("sample_id", F.col("i").cast("long").alias("i"), rnd("v", 5))


@query("R6_resample_by_pixel", ["img_tile", "site", "topo_pixel"], _RESAMPLED + "SELECT sample_id, CAST(i AS INTEGER) AS i, round(max(v) FILTER (band = 0), 5) AS b0, round(max(v) FILTER (band = 1), 5) AS b1, round(max(v) FILTER (band = 2), 5) AS b2, round(max(v) FILTER (band = 3), 5) AS b3 FROM m GROUP BY 1, 2")
def resample_by_pixel(i: Inputs):
    blocks = r.to_blocks(i.topo_pixel, [], "band", 4, 4)
    d = r.bilinear(r.target_pixels(windows(i), TOPO_GRID, 4), blocks, 4, 4)
    inside = d.filter("b0 IS NOT NULL OR b1 IS NOT NULL OR b2 IS NOT NULL OR b3 IS NOT NULL")
    return inside.select("sample_id", "i", *[rnd(f"b{k}", 5) for k in range(4)])


@query(
    "R7_aspect_to_ne", ["chip_pixel"],
    "SELECT vec_id, band, y, x, round(CASE WHEN v <= 360 THEN cos(radians(v)) END, 6) AS northness, round(CASE WHEN v <= 360 THEN sin(radians(v)) END, 6) AS eastness FROM chip_pixel",
)
def aspect_to_ne(i: Inputs):
    n, e = arrays.aspect_components(F.col("v"))
    return pixels(chip_rows(i), F.col("px")).select("vec_id", "band", "y", "x", rnd(n, 6, "northness"), rnd(e, 6, "eastness"))


_STATS_SQL = "CASE band " + " ".join(f"WHEN {k} THEN (v - ({TERRAIN_STATS[b][0]!r})) / {TERRAIN_STATS[b][1]!r}" for k, b in enumerate(TERRAIN_BANDS)) + " END"
_NORM = [TERRAIN_STATS[b] for b in TERRAIN_BANDS]


@query("R8_normalize_topo", ["chip_pixel"], f"SELECT vec_id, band, y, x, round({_STATS_SQL}, 6) AS v FROM chip_pixel")
def normalize_topo(i: Inputs):
    return pixels(chip_rows(i), r.normalize_bands(F.col("px"), 16, _NORM)).withColumn("v", F.round("v", 6))


@query(
    "R9_summarize_topo", ["chip_pixel", "embeddings"],
    f"""WITH n AS (SELECT vec_id, band, y, x, {_STATS_SQL} AS v FROM chip_pixel), ok AS (SELECT vec_id, y, x FROM n GROUP BY 1, 2, 3 HAVING count(v) = 4), m AS (SELECT n.* FROM n JOIN ok USING (vec_id, y, x))
 SELECT vec_id, round(avg(v) FILTER (band = 0), 6) AS elev_mean, round(stddev_pop(v) FILTER (band = 0), 6) AS elev_sd, round(min(v) FILTER (band = 0), 6) AS elev_min, round(max(v) FILTER (band = 0), 6) AS elev_max,
 round(avg(v) FILTER (band = 1), 6) AS slope_mean, round(stddev_pop(v) FILTER (band = 1), 6) AS slope_sd, round(min(v) FILTER (band = 1), 6) AS slope_min, round(max(v) FILTER (band = 1), 6) AS slope_max,
 round(avg(v) FILTER (band = 2), 6) AS northness_mean, round(avg(v) FILTER (band = 3), 6) AS eastness_mean, round(count(v) / 64.0, 6) AS topo_valid_frac FROM embeddings LEFT JOIN m USING (vec_id) GROUP BY vec_id""",
)
def summarize_topo(i: Inputs):
    d = r.summarize_topo(chip_rows(i).withColumn("px", r.normalize_bands(F.col("px"), 16, _NORM)), "px", 16)
    cols = [c for c in d.columns if c not in ("vec_id", "px")]
    return d.select("vec_id", *[rnd(c) for c in cols])


@query(
    "R10_valid_fraction", ["chip_pixel"],
    "WITH p AS (SELECT vec_id, y, x, count(v) AS k FROM chip_pixel GROUP BY 1, 2, 3) SELECT vec_id, round(avg(CASE WHEN k = 4 THEN 1.0 ELSE 0.0 END), 6) AS share FROM p GROUP BY vec_id",
)
def valid_fraction(i: Inputs):
    return chip_rows(i).select("vec_id", rnd(r.valid_fraction(F.col("px"), 4, 16), 6, "share"))


@query("R11_scale_255", ["chip_pixel"], "SELECT vec_id, band, y, x, round(CASE WHEN v IS NOT NULL THEN least(v / 255, 1) END, 6) AS v FROM chip_pixel")
def scale_255(i: Inputs):
    return pixels(chip_rows(i), arrays.scale_255(F.col("px"))).withColumn("v", F.round("v", 6))


@query(
    "R12_flip", ["chip_pixel"],
    "SELECT vec_id, band, CASE WHEN vec_id % 2 = 0 THEN 3 - y ELSE y END AS y, CASE WHEN vec_id % 3 = 0 THEN 3 - x ELSE x END AS x, v FROM chip_pixel",
)
def flip(i: Inputs):
    return pixels(chip_rows(i), arrays.plane_flip(F.col("px"), 4, 4, F.col("vec_id") % 3 == 0, F.col("vec_id") % 2 == 0))


@query("R13_rotate", ["chip_pixel"], "SELECT vec_id, band, x AS y, 3 - y AS x, coalesce(v, 0) AS v FROM chip_pixel")
def rotate(i: Inputs):
    # A quarter turn clockwise is exact; the kernel's bilinear weights are tested apart.
    d = chip_rows(i).withColumn("angle", F.lit(-90.0))
    return pixels(r.rotate(d, "px", "angle", 4, 4, 4), F.col("px")).withColumn("v", F.round("v", 6))


_U = "(CAST(CAST(concat('0x', substr(md5(concat(md5(concat('{s}:', vec_id)), ':{d}')), 1, 13)) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)"


def _augment_sql(seed: int) -> str:
    u = [_U.format(s=seed, d=k) for k in range(3)]
    return f"SELECT vec_id, round(({u[0]} * 2 - 1) * 30, 6) AS angle, {u[1]} < 0.5 AS hflip, {u[2]} < 0.25 AS vflip FROM embeddings"


@query("R14_augment", ["embeddings"], _augment_sql(42))
def augment(i: Inputs):
    d = r.augment_params(i.embeddings.select("vec_id"), "vec_id", 42, 30.0, 0.5, 0.25)
    return d.withColumn("angle", F.round("angle", 6))


@query("R15_augment_paired", ["embeddings"], f"SELECT a.*, kind FROM ({_augment_sql(7)}) a, (VALUES ('image'), ('topo')) k(kind)")
def augment_paired(i: Inputs):
    d = i.embeddings.select("vec_id", F.explode(F.array(F.lit("image"), F.lit("topo"))).alias("kind"))
    return r.augment_params(d, "vec_id", 7, 30.0, 0.5, 0.25).withColumn("angle", F.round("angle", 6))


def _turned_sql(seed: int, train: str) -> str:
    """Bilinear weights of every turned and mirrored pixel of the training rows, written out."""
    u = [_U.format(s=seed, d=k) for k in range(3)]
    return f"""prm AS (SELECT vec_id, radians(({u[0]} * 2 - 1) * 30) AS t, CASE WHEN {u[1]} < 0.5 THEN -1 ELSE 1 END AS fx, CASE WHEN {u[2]} < 0.25 THEN -1 ELSE 1 END AS fy FROM embeddings WHERE {train}),
 src AS (SELECT *, cos(t) * (x - 1.5) * fx - sin(t) * (y - 1.5) * fy + 1.5 AS sx, sin(t) * (x - 1.5) * fx + cos(t) * (y - 1.5) * fy + 1.5 AS sy
   FROM prm, (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x)),
 nb AS (SELECT *, CAST(floor(sx) AS BIGINT) + ox AS nx, CAST(floor(sy) AS BIGINT) + oy AS ny FROM src, (VALUES (0),(1)) o(ox), (VALUES (0),(1)) q(oy)),
 trn AS (SELECT s.vec_id, b.band, s.y, s.x, any_value(t) AS t, any_value(fx) AS fx, any_value(fy) AS fy, sum((1 - abs(sx - nx)) * (1 - abs(sy - ny)) * coalesce(p.v, 0)) AS v
   FROM nb s CROSS JOIN (SELECT unnest(range(4)) AS band) b LEFT JOIN chip_pixel p ON p.vec_id = s.vec_id AND p.band = b.band AND p.y = ny AND p.x = nx GROUP BY 1, 2, 3, 4)"""


@query(
    "R14_augment_chips", ["embeddings", "chip_pixel"],
    f"WITH {_turned_sql(42, 'vec_id % 5 <> 0')} SELECT vec_id, band, y, x, round(coalesce(v, 0), 6) + 0 AS v FROM trn UNION ALL SELECT vec_id, band, y, x, v FROM chip_pixel WHERE vec_id % 5 = 0",
)
def augment_chips(i: Inputs):
    d = r.augment(chip_rows(i), "vec_id", {"px": (4, 4, 4)}, 42, 30.0, 0.5, 0.25, F.col("vec_id") % 5 != 0)
    return pixels(d, F.col("px")).withColumn("v", F.round("v", 6))


@query(
    "R15_augment_paired_chips", ["embeddings", "chip_pixel"],
    f"""WITH {_turned_sql(7, 'vec_id % 5 <> 0')}, dir AS (SELECT vec_id, y, x, any_value(t) AS t, any_value(fx) AS fx, any_value(fy) AS fy, sum(coalesce(v, 0)) FILTER (band = 2) AS n, sum(coalesce(v, 0)) FILTER (band = 3) AS e FROM trn GROUP BY 1, 2, 3),
 alls AS (SELECT 'image' AS kind, vec_id, band, y, x, coalesce(v, 0) AS v FROM trn UNION ALL SELECT 'topo', vec_id, band, y, x, coalesce(v, 0) FROM trn WHERE band < 2
   UNION ALL SELECT 'topo', vec_id, 2, y, x, (sin(t) * e + cos(t) * n) * fy FROM dir UNION ALL SELECT 'topo', vec_id, 3, y, x, (cos(t) * e - sin(t) * n) * fx FROM dir
   UNION ALL SELECT kind, vec_id, band, y, x, v FROM chip_pixel, (VALUES ('image'), ('topo')) k(kind) WHERE vec_id % 5 = 0)
 SELECT kind, vec_id, band, y, x, round(v, 5) AS v FROM alls""",
)
def augment_paired_chips(i: Inputs):
    both = chip_rows(i).withColumn("topo", F.col("px"))
    d = r.augment(both, "vec_id", {"px": (4, 4, 4), "topo": (4, 4, 4)}, 7, 30.0, 0.5, 0.25, F.col("vec_id") % 5 != 0, {"topo": (2, 3)})
    parts = [pixels(d, F.col(c)).withColumn("kind", F.lit(k)) for c, k in (("px", "image"), ("topo", "topo"))]
    return parts[0].unionByName(parts[1]).withColumn("v", F.round("v", 5))


@query("R17_encode_nodata", ["chip_pixel"], "SELECT vec_id, band, y, x, coalesce(v, -9999) AS v FROM chip_pixel")
def encode_nodata(i: Inputs):
    return pixels(chip_rows(i), arrays.encode_nodata(F.col("px")))


_GRID = """rows AS (SELECT *, unnest(range(0, height - 255, 128)) AS row FROM {t} WHERE height >= 256 AND width >= 256), grid AS (SELECT *, unnest(range(0, width - 255, 128)) AS col FROM rows)"""


@query("T1_chip_grid", ["tile_dims"], f"WITH {_GRID.format(t='tile_dims')} SELECT tile_id, row, col FROM grid")
def chip_grid(i: Inputs):
    return t.chip_grid(i.tile_dims, 256, 128).select("tile_id", "row", "col")


def _utm_inverse_sql(x: str, y: str, src: str) -> str:
    from ...functions.geo import krueger_constants

    k = krueger_constants()
    e, s = k["e"], 0.9996 * k["radius"]
    sh, ch = "(exp({a}) - exp(-({a}))) / 2", "(exp({a}) + exp(-({a}))) / 2"
    xi0 = " - ".join(["xi", *[f"{b!r} * sin({2 * j} * xi) * ({ch.format(a=f'{2 * j} * eta')})" for j, b in enumerate(k["beta"], 1)]])
    eta0 = " - ".join(["eta", *[f"{b!r} * cos({2 * j} * xi) * ({sh.format(a=f'{2 * j} * eta')})" for j, b in enumerate(k["beta"], 1)]])
    steps, last = [], "s0"
    for n in range(1, 5):
        steps.append(f"i{n} AS (SELECT *, tanh(psi + {e} * atanh({e} * {last})) AS s{n} FROM {'i' + str(n - 1)})")
        last = f"s{n}"
    return f"""q1 AS (SELECT *, ({y}) / {s!r} AS xi, (({x}) - 500000) / {s!r} AS eta FROM {src}), q2 AS (SELECT *, {xi0} AS xi0, {eta0} AS eta0 FROM q1),
 q3 AS (SELECT *, asinh(sin(xi0) / sqrt(power({sh.format(a='eta0')}, 2) + power(cos(xi0), 2))) AS psi FROM q2), i0 AS (SELECT *, tanh(psi) AS s0 FROM q3), {', '.join(steps)},
 ll AS (SELECT *, degrees(asin(s4)) AS lat, zone * 6 - 183 + degrees(atan2({sh.format(a='eta0')}, cos(xi0))) AS lon FROM i4)"""


@query(
    "T2_chip_centre", ["utm_tile"],
    f"WITH {_GRID.format(t='utm_tile')}, c AS (SELECT *, x0 + col + 128 AS mx, y0 - (row + 128) AS my FROM grid), {_utm_inverse_sql('mx', 'my', 'c')} SELECT tile_id, row, col, round(lat, 7) AS lat, round(lon, 7) AS lon FROM ll",
)
def chip_centre(i: Inputs):
    d = t.chip_centre(t.chip_grid(i.utm_tile, 256, 128), 256)
    return d.select("tile_id", "row", "col", rnd("lat", 7), rnd("lon", 7))


@query(
    "T2_chip_centre_south", ["utm_tile"],
    f"WITH {_GRID.format(t='utm_tile')}, c AS (SELECT *, x0 + col + 128 AS mx, y0 + row + 128 AS my FROM grid), {_utm_inverse_sql('mx', 'my', 'c')} SELECT tile_id, row, col, round(-lat, 7) AS lat, round(lon, 7) AS lon FROM ll",
)
def chip_centre_south(i: Inputs):
    # The same tiles mirrored at the equator.
    south = i.utm_tile.withColumn("y0", 10_000_000 - F.col("y0")).withColumn("north", F.lit(False))
    d = t.chip_centre(t.chip_grid(south, 256, 128), 256)
    return d.select("tile_id", "row", "col", rnd("lat", 7), rnd("lon", 7))


_CHIPIN = """WITH p AS (SELECT vec_id, y, x, count(v) AS k, max(v) AS hi FROM chip_pixel GROUP BY 1, 2, 3),
 q AS (SELECT vec_id, avg(CASE WHEN k = 4 AND hi <> 0 THEN 1.0 ELSE 0.0 END) AS img, avg(CASE WHEN k = 4 THEN 1.0 ELSE 0.0 END) AS top FROM p GROUP BY vec_id),
 f AS (SELECT vec_id, count(v) FILTER (i IN (0, 5)) AS known FROM chip_pixel GROUP BY vec_id)
"""


def _score_inputs(i: Inputs, family: str):
    d = chip_rows(i).withColumn("topo", F.col("px")).withColumn("lat_norm", F.col("px")[0]).withColumn("lon_norm", F.col("px")[5])
    return t.chip_inputs(d, family, ["lat_norm", "lon_norm", "elev_mean"], 16, 16, 0.45, 0.40)


@query(
    "T3_chip_inputs", ["chip_pixel"],
    _CHIPIN + "SELECT vec_id, CASE WHEN img < 0.45 THEN 'image' WHEN top < 0.4 THEN 'topo' WHEN known < 2 OR top = 0 THEN 'env' END AS skip_reason FROM q JOIN f USING (vec_id)",
)
def chip_inputs(i: Inputs):
    return _score_inputs(i, "full").select("vec_id", "skip_reason")


@query("T4_mc_aggregate", ["mc_pass"], "SELECT sample_id, round(avg(probability), 6) AS mean_p, round(stddev_pop(probability), 6) AS std_p FROM mc_pass GROUP BY sample_id")
def mc_aggregate(i: Inputs):
    return t.mc_aggregate(i.mc_pass, ["sample_id"]).select("sample_id", rnd("mean_p"), rnd("std_p"))


_SCORED = f"""{_GRID.format(t='{t}')}, sc AS (SELECT tile_id, row, col, ((tile_id * 31 + row * 7 + col * 3) % 1000) / 1000.0 AS p, ((tile_id + row + col) % 100) / 400.0 AS s FROM grid),
 cr AS (SELECT *, unnest(range(2)) AS i FROM sc), cc AS (SELECT *, unnest(range(2)) AS j FROM cr),
 mos AS (SELECT tile_id, CAST(row / 128 AS BIGINT) + i AS cell_row, CAST(col / 128 AS BIGINT) + j AS cell_col, avg(p) AS prediction, avg(s) AS uncertainty, count(*) AS n_chips FROM cc GROUP BY 1, 2, 3)"""


def mosaic(tile_rows):
    """Mosaic of made-up chip scores on 256-pixel chips with stride 128."""
    d = t.chip_grid(tile_rows, 256, 128)
    d = d.withColumn("mean_p", (F.col("tile_id") * 31 + F.col("row") * 7 + F.col("col") * 3) % 1000 / 1000)
    d = d.withColumn("std_p", (F.col("tile_id") + F.col("row") + F.col("col")) % 100 / 400)
    return t.overlap_mosaic(d, 256, 128)


@query(
    "T5_overlap_mosaic", ["tile_dims"],
    f"WITH {_SCORED.replace('{t}', 'tile_dims')} SELECT tile_id, cell_row, cell_col, round(prediction, 6) AS prediction, round(uncertainty, 6) AS uncertainty, n_chips FROM mos",
)
def overlap_mosaic(i: Inputs):
    return mosaic(i.tile_dims).select("tile_id", "cell_row", "cell_col", rnd("prediction"), rnd("uncertainty"), "n_chips")


def _reproject_sql(res: float = 60.0) -> str:
    corners = " UNION ALL ".join(
        f"SELECT tile_id, height, width, x0, y0, zone, x0 + {c} AS mx, y0 - {r} AS my FROM utm_tile" for r in ("0", "height") for c in ("0", "width")
    )
    return f"""WITH cn AS ({corners}), {_utm_inverse_sql('mx', 'my', 'cn')},
 al AS (SELECT tile_id, height, width, x0, y0, zone, {albers_sql('lat', 'lon', 'ax', 'ay')} FROM ll),
 bx AS (SELECT tile_id, height, width, x0, y0, zone, CAST(min(floor(ax / {res})) AS BIGINT) AS x1, CAST(max(floor(ax / {res})) AS BIGINT) AS x2, CAST(min(floor(ay / {res})) AS BIGINT) AS y1, CAST(max(floor(ay / {res})) AS BIGINT) AS y2 FROM al GROUP BY ALL),
 gy AS (SELECT *, unnest(generate_series(y1, y2)) AS gy FROM bx), gg AS (SELECT *, unnest(generate_series(x1, x2)) AS gx FROM gy),
 tl AS (SELECT tile_id, height, width, x0, y0, zone, gx, gy, (gx + 0.5) * {res} AS tx, (gy + 0.5) * {res} AS ty FROM gg), tg AS (SELECT *, {albers_inverse_sql('tx', 'ty')} FROM tl), {utm_forward_sql('tg')},
 uv AS (SELECT tile_id, height, width, gx, gy, ux - x0 - 0.5 AS u, y0 - uy - 0.5 AS v FROM uf),
 nb AS (SELECT *, CAST(floor(v) AS BIGINT) + oy AS r, CAST(floor(u) AS BIGINT) + ox AS c FROM uv, (VALUES (0),(1)) o(ox), (VALUES (0),(1)) q(oy)),
 wt AS (SELECT tile_id, gx, gy, CAST(floor(r / 128) AS BIGINT) AS cell_row, CAST(floor(c / 128) AS BIGINT) AS cell_col, (1 - abs(u - c)) * (1 - abs(v - r)) AS w FROM nb WHERE r >= 0 AND c >= 0 AND r < height AND c < width),
 {_SCORED.replace('{t}', 'utm_tile')}
 SELECT tile_id, gx, gy, round(sum(w * prediction) / sum(w), 4) AS prediction, round(sum(w * uncertainty) / sum(w), 4) AS uncertainty FROM wt JOIN mos USING (tile_id, cell_row, cell_col) WHERE w > 0 GROUP BY 1, 2, 3"""


@query("T6_mosaic_reproject", ["utm_tile"], _reproject_sql())
def mosaic_reproject(i: Inputs):
    # Dealt out, since one file may hold all tiles and a tile has many chips.
    utm_tile = materialize(i.utm_tile.repartition("tile_id"), "utm_tiles")
    d = t.mosaic_reproject(mosaic(utm_tile), utm_tile, 128, 60.0)
    return d.select("tile_id", "gx", "gy", rnd("prediction", 4), rnd("uncertainty", 4))


@query(
    "T7_tile_summary", ["chip_pixel"],
    _CHIPIN + """SELECT CAST(floor(vec_id / 25) AS BIGINT) AS tile_id, count(*) FILTER (img >= 0.45 AND top >= 0.4) AS processed_chips, count(*) FILTER (img < 0.45) AS skipped_image_chips,
 count(*) FILTER (img >= 0.45 AND top < 0.4) AS skipped_topo_chips, CAST(0 AS BIGINT) AS skipped_env_chips, 'ok' AS status FROM q GROUP BY 1""",
)
def tile_summary(i: Inputs):
    d = _score_inputs(i, "image_topo").withColumn("tile_id", F.floor(F.col("vec_id") / 25))
    return t.tile_summary(d, i.img_tile).drop("error")



@query(
    "T_scoring_flow", ["tile_dims", "chip_pixel", "embeddings"],
    _CHIPIN + f""", {_GRID.format(t='tile_dims')}, m AS (SELECT count(*) AS m FROM embeddings),
 bad AS (SELECT tile_id, concat('chips missing: ', count(*)) AS error FROM grid WHERE tile_id % 50 = 7 GROUP BY tile_id),
 ch AS (SELECT tile_id, row, col, ((tile_id * 31 + row * 7 + col * 3) % 1000) / 1000.0 AS p, CASE WHEN img < 0.45 THEN 'image' WHEN top < 0.4 THEN 'topo' END AS why
   FROM grid, m JOIN q ON q.vec_id = (tile_id * 7 + row // 128 + col // 128) % m WHERE tile_id % 50 <> 7),
 cr AS (SELECT *, unnest(range(2)) AS i FROM ch WHERE why IS NULL), cc AS (SELECT *, unnest(range(2)) AS j FROM cr),
 mos AS (SELECT tile_id, row // 128 + i AS cell_row, col // 128 + j AS cell_col, avg(p * 9.5 / 17) AS prediction, avg(p / 17 * sqrt(1.25)) AS uncertainty FROM cc GROUP BY 1, 2, 3),
 per AS (SELECT tile_id, count(*) AS covered, avg(prediction) AS prediction, avg(uncertainty) AS uncertainty FROM mos GROUP BY tile_id),
 cnt AS (SELECT tile_id, count(*) FILTER (why IS NULL) AS ok, count(*) FILTER (why = 'image') AS img, count(*) FILTER (why = 'topo') AS top FROM ch GROUP BY tile_id)
 SELECT tile_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error, coalesce(ok, 0) AS processed_chips, coalesce(img, 0) AS skipped_image_chips, coalesce(top, 0) AS skipped_topo_chips,
  CASE WHEN error IS NULL THEN CAST(ceil(height / 128.0) * ceil(width / 128.0) AS BIGINT) ELSE 0 END AS n_squares,
  CASE WHEN error IS NULL THEN CAST(ceil(height / 128.0) * ceil(width / 128.0) AS BIGINT) - coalesce(covered, 0) ELSE 0 END AS n_uncovered, round(prediction, 6) AS prediction, round(uncertainty, 6) AS uncertainty
 FROM tile_dims LEFT JOIN bad USING (tile_id) LEFT JOIN cnt USING (tile_id) LEFT JOIN per USING (tile_id)""",
)
def scoring_flow(i: Inputs):
    from ...session import scratch_path
    from .. import scoring

    path = scratch_path(i.spark, "scores")
    # One tile in fifty has no chips. The first run ends after half of the tiles, the second resumes.
    grid = t.chip_grid(i.tile_dims, 256, 128).filter("tile_id % 50 <> 7").select("tile_id", "row", "col")
    pick = (F.col("tile_id") * 7 + F.floor(F.col("row") / 128) + F.floor(F.col("col") / 128)) % i.embeddings.agg(F.count(F.lit(1))).scalar()
    chips = grid.withColumn("vec_id", pick).join(chip_rows(i).withColumn("topo", F.col("px")), "vec_id").drop("vec_id")
    chips = materialize(chips, "chips")

    def scorer(d):
        p = (F.col("tile_id") * 31 + F.col("row") * 7 + F.col("col") * 3) % 1000 / 1000
        passes = d.select("tile_id", "row", "col", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
        return passes.withColumn("probability", p * (8 + F.col("k")) / 17)

    for tiles in (i.tile_dims.filter("tile_id % 2 = 0"), i.tile_dims):
        scoring.score_tiles(tiles, chips, path, "image_topo", [], scorer, 16, 16, 256, 128, 0.45, 0.40)
    known = F.col("n_chips") > 0
    per = scoring.read_scores(i.spark, path).groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n_squares"), F.count_if(~known).alias("n_uncovered"),
        F.avg(F.when(known, F.col("prediction"))).alias("prediction"), F.avg(F.when(known, F.col("uncertainty"))).alias("uncertainty"),
    )
    d = scoring.last_log(i.spark, path).join(per.hint("merge"), "tile_id", "left").fillna(0, ["n_squares", "n_uncovered"])
    counts = ["processed_chips", "skipped_image_chips", "skipped_topo_chips", "n_squares", "n_uncovered"]
    return d.select("tile_id", "status", "error", *counts, rnd("prediction"), rnd("uncertainty"))
