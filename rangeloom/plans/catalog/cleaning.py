"""Cleaning, projection and dataset-check queries (P*, G*, text functions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import arrays, geo, text
from ...operators import clean, sampling, splits
from ..registry import Inputs, query
from .common import CELL_SQL, GRID, albers_sql, rnd, uniform_sql

@query(
    "P1_clean_coords", ["occ_raw"],
    """SELECT occ_id, species, try_cast(lat_text AS DOUBLE) AS lat, try_cast(lon_text AS DOUBLE) AS lon FROM occ_raw
 WHERE try_cast(lat_text AS DOUBLE) BETWEEN -90 AND 90 AND try_cast(lon_text AS DOUBLE) BETWEEN -180 AND 180""",
)
def clean_coords(i: Inputs):
    d = clean.clean_coords(i.occ_raw, "lat_text", "lon_text")
    return d.select("occ_id", "species", "lat", "lon")


@query(
    "P2_uncertainty_filter", ["occ_raw"],
    "SELECT occ_id, try_cast(uncertainty_text AS DOUBLE) AS coordinate_uncertainty_m FROM occ_raw WHERE try_cast(uncertainty_text AS DOUBLE) <= 1000",
)
def uncertainty_filter(i: Inputs):
    return clean.uncertainty_filter(i.occ_raw, "uncertainty_text", 1000.0).select("occ_id", "coordinate_uncertainty_m")


@query(
    "P3_fill_defaults", ["occ_raw"],
    "SELECT occ_id, coalesce(source_raw, 'unknown') AS source, concat(upper(substr(species, 1, 1)), lower(substr(species, 2))) AS species FROM occ_raw",
)
def fill_defaults(i: Inputs):
    d = clean.fill_defaults(i.occ_raw, "source_raw", text.title_case(F.col("species")))
    return d.select("occ_id", "source", "species")


_WIDE = """WITH w AS (SELECT r, c, max(v) FILTER (layer = 0) AS a, max(v) FILTER (layer = 1) AS b, max(v) FILTER (layer = 2) AS d, count(v) AS known, max(v) AS hi FROM env_pixel GROUP BY r, c)
"""


def _wide(i: Inputs):
    """One row per raster cell with its layers as columns."""
    return i.env_pixel.groupBy("r", "c").agg(*[F.max(F.when(F.col("layer") == k, F.col("v"))).alias(f"e{k}") for k in range(20)])


@query("P5_valid_env", ["env_pixel"], _WIDE + "SELECT r, c FROM w WHERE known = 20 AND hi <= 120")
def valid_env(i: Inputs):
    return clean.valid_env(_wide(i), [f"e{k}" for k in range(20)], -100.0, 120.0).select("r", "c")


@query(
    "P6_topo_coverage", ["chip_pixel"],
    """WITH p AS (SELECT vec_id, y, x, count(v) AS k FROM chip_pixel GROUP BY 1, 2, 3)
 SELECT vec_id, round(avg(CASE WHEN k = 4 THEN 1.0 ELSE 0.0 END), 6) AS topo_valid_frac FROM p GROUP BY vec_id HAVING avg(CASE WHEN k = 4 THEN 1.0 ELSE 0.0 END) >= 0.5""",
)
def topo_coverage(i: Inputs):
    from .rasters import chip_rows
    from ...operators.rasters import valid_fraction

    d = chip_rows(i).withColumn("topo_valid_frac", valid_fraction(F.col("px"), 4, 16))
    return clean.topo_coverage(d, 0.5).select("vec_id", rnd("topo_valid_frac"))


@query(
    "P7_image_window_valid", ["chip_pixel"],
    """WITH p AS (SELECT vec_id, y, x, count(v) = 4 AND max(v) <> 0 AS ok FROM chip_pixel GROUP BY 1, 2, 3)
 SELECT vec_id, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) >= 0.9 AS usable FROM p GROUP BY vec_id""",
)
def image_window_valid(i: Inputs):
    from .rasters import chip_rows
    from ...operators.rasters import image_window_valid as ok

    return chip_rows(i).select("vec_id", ok(F.col("px"), 4, 16, 0.9).alias("usable"))


@query(
    "P8_audit_predictors", ["occ"],
    """WITH o AS (SELECT CASE WHEN occ_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, coordinate_uncertainty_m AS u, lat / 100 AS n, occ_id % 5 <> 0 AS ok FROM occ),
 a AS (SELECT split, count(*) AS n_rows, count(*) FILTER (NOT ok) AS n_raw_terrain, count(*) FILTER (u IS NULL) AS bad FROM o GROUP BY split)
 SELECT split, n_rows, n_raw_terrain, 'ghm' AS predictor, bad AS n_nonfinite FROM a UNION ALL SELECT split, n_rows, n_raw_terrain, 'lat_norm', 0 FROM a""",
)
def audit(i: Inputs):
    d = i.occ.select(
        F.when(F.col("occ_id") % 3 == 0, "test").otherwise("train").alias("split"),
        F.coalesce("coordinate_uncertainty_m", F.lit(float("nan"))).alias("ghm"),
        (F.col("lat") / 100).alias("lat_norm"),
        F.when(F.col("occ_id") % 5 == 0, "no").otherwise("TRUE").alias("topo_normalized"),
    )
    return clean.audit_predictors(d)


@query("P14_zero_fill", ["chip_pixel"], "SELECT vec_id, band, y, x, coalesce(v, 0) AS v FROM chip_pixel")
def zero_fill(i: Inputs):
    from .rasters import chip_rows, pixels

    return pixels(chip_rows(i), arrays.zero_fill(F.col("px")))


@query(
    "P15_env_vector", ["env_pixel"],
    """WITH w AS (SELECT r, c, count(v) AS known, sum(v * (layer + 1)) AS total FROM env_pixel GROUP BY r, c)
 SELECT count(*) FILTER (known = 20) AS n_usable, count(*) FILTER (known < 20) AS skipped_env, round(sum(total) FILTER (known = 20), 6) AS checksum FROM w""",
)
def env_vector(i: Inputs):
    d = clean.env_vector(_wide(i), [f"e{k}" for k in range(20)])
    total = F.aggregate(F.transform("features", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return d.agg(
        F.count_if("usable").alias("n_usable"), F.count_if(~F.col("usable")).alias("skipped_env"),
        rnd(F.sum(F.when(F.col("usable"), total)), 6, "checksum"),
    )


@query("P16_chip_exists", ["occ", "embeddings"], "SELECT occ_id FROM occ WHERE user_id IN (SELECT vec_id FROM embeddings)")
def chip_exists(i: Inputs):
    chips = i.embeddings.select(F.col("vec_id").alias("user_id"))
    return clean.chip_exists(i.occ, chips, ["user_id"]).select("occ_id")


@query("G1_albers_xy", ["occ"], f"SELECT occ_id, round(x, 3) AS x, round(y, 3) AS y FROM (SELECT occ_id, {albers_sql()} FROM occ) s")
def albers(i: Inputs):
    return sampling.with_albers(i.occ).select("occ_id", rnd("x", 3), rnd("y", 3))


@query("G2_albers_inverse", ["occ"], "SELECT occ_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM occ")
def albers_inverse(i: Inputs):
    d = sampling.with_albers(i.occ)
    lat, lon = geo.albers_inverse(F.col("x"), F.col("y"))
    return d.select("occ_id", rnd(lat, 7, "lat"), rnd(lon, 7, "lon"))


def utm_forward_sql(src: str) -> str:
    """CTEs adding UTM metres `ux`, `uy` to `src` (columns lat, lon, zone); the last one is named uf."""
    k = geo.krueger_constants()
    e, r = k["e"], k["radius"] * 0.9996
    s = "sin(radians(lat))"
    east = " + ".join(["eta", *[f"{a!r} * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, a in enumerate(k["alpha"], 1)]])
    north = " + ".join(["xi", *[f"{a!r} * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, a in enumerate(k["alpha"], 1)]])
    return f"""ua AS (SELECT *, radians(lon - (zone * 6 - 183)) AS dl, ln((1 + {s}) / (1 - {s})) / 2 - {e} * ln((1 + {e} * {s}) / (1 - {e} * {s})) / 2 AS qq FROM {src}),
 ub AS (SELECT *, (exp(qq) - exp(-qq)) / 2 AS tt FROM ua),
 uc AS (SELECT *, atan2(tt, cos(dl)) AS xi, ln((1 + sin(dl) / sqrt(1 + tt * tt)) / (1 - sin(dl) / sqrt(1 + tt * tt))) / 2 AS eta FROM ub),
 uf AS (SELECT *, 500000 + {r!r} * ({east}) AS ux, {r!r} * ({north}) AS uy FROM uc)"""


_UTM = f"""WITH z AS (SELECT occ_id, lat, lon, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone FROM occ), {utm_forward_sql('z')}
 SELECT occ_id, zone, round(ux, 3) AS x, round(uy, 3) AS y FROM uf"""


@query("G3_utm_xy", ["occ"], _UTM)
def utm(i: Inputs):
    d = i.occ.withColumn("zone", geo.utm_zone(F.col("lon")))
    x, y = geo.utm_xy(F.col("lat"), F.col("lon"), F.col("zone"))
    return d.select("occ_id", "zone", rnd(x, 3, "x"), rnd(y, 3, "y"))


@query("G3_utm_inverse", ["occ"], "SELECT occ_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM occ")
def utm_inverse(i: Inputs):
    d = i.occ.withColumn("zone", geo.utm_zone(F.col("lon")))
    x, y = geo.utm_xy(F.col("lat"), F.col("lon"), F.col("zone"))
    d = d.select("occ_id", "zone", x.alias("x"), y.alias("y"))
    lat, lon = geo.utm_inverse(F.col("x"), F.col("y"), F.col("zone"))
    return d.select("occ_id", rnd(lat, 7, "lat"), rnd(lon, 7, "lon"))


@query("G4_web_mercator", ["occ"], "SELECT occ_id, round(6378137 * radians(lon), 3) AS x, round(6378137 * ln(tan(radians(45 + lat / 2))), 3) AS y FROM occ")
def web_mercator(i: Inputs):
    x, y = geo.web_mercator(F.col("lat"), F.col("lon"))
    return i.occ.select("occ_id", rnd(x, 3, "x"), rnd(y, 3, "y"))


@query("G5_cell_id", ["occ"], f"SELECT occ_id, concat(cell_row, '_', cell_col) AS cell_id FROM (SELECT occ_id, {CELL_SQL.format(a='')} FROM occ) s")
def cell_id(i: Inputs):
    return sampling.with_cell(i.occ, GRID).select("occ_id", geo.cell_label(F.col("cell_row"), F.col("cell_col")).alias("cell_id"))


@query("G6_affine_xy", ["tile_dims"], "SELECT tile_id, 1000 + width / 2.0 * 0.5 AS cx, 2000 - height / 2.0 * 0.5 AS cy FROM tile_dims")
def affine_xy(i: Inputs):
    x, y = geo.pixel_to_map(F.col("height") / 2, F.col("width") / 2, F.lit(1000.0), F.lit(2000.0), F.lit(0.5), F.lit(0.5))
    return i.tile_dims.select("tile_id", x.alias("cx"), y.alias("cy"))


@query(
    "G7_annulus_offset", ["occ"],
    f"""SELECT occ_id, round(dist * cos(ang), 3) AS ox, round(dist * sin(ang), 3) AS oy FROM (SELECT occ_id, {uniform_sql('order_key', 1)} * 6.283185307179586 AS ang,
 sqrt({uniform_sql('order_key', 2)} * (2500000000.0 - 25000000.0) + 25000000.0) AS dist FROM occ) s""",
)
def annulus_offset(i: Inputs):
    ox, oy = geo.annulus_offset(F.col("order_key"), 5000.0, 50000.0)
    return i.occ.select("occ_id", rnd(ox, 3, "ox"), rnd(oy, 3, "oy"))


@query(
    "G9_planar_distance", ["occ"],
    f"SELECT occ_id, round(sqrt(power(x, 2) + power(y - 1000000, 2)), 3) AS metres FROM (SELECT occ_id, {albers_sql()} FROM occ) s",
)
def planar_distance(i: Inputs):
    d = sampling.with_albers(i.occ)
    return d.select("occ_id", rnd(geo.planar_distance(F.col("x"), F.col("y"), F.lit(0.0), F.lit(1000000.0)), 3, "metres"))


@query(
    "G8_point_in_ring", ["occ"],
    "SELECT occ_id, (lat - 30) > 0 AND (lon + 120) > 0 AND (lat - 30) / 10 + (lon + 120) / 30 < 1 AS inside FROM occ",
)
def point_in_ring(i: Inputs):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-120.0, 30.0), (-90.0, 30.0), (-120.0, 40.0))])
    return i.occ.select("occ_id", geo.point_in_ring(F.col("lon"), F.col("lat"), ring).alias("inside"))


@query(
    "G10_padded_extent", ["occ"],
    """WITH m AS (SELECT presence, 6378137 * radians(lon) AS x, 6378137 * ln(tan(radians(45 + lat / 2))) AS y FROM occ),
 b AS (SELECT presence, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM m GROUP BY presence)
 SELECT presence, round(x1 - p, 3) AS xmin, round(x2 + p, 3) AS xmax, round(y1 - p, 3) AS ymin, round(y2 + p, 3) AS ymax FROM (SELECT *, greatest(x2 - x1, y2 - y1, 1000) * 0.05 AS p FROM b) s""",
)
def padded_extent(i: Inputs):
    x, y = geo.web_mercator(F.col("lat"), F.col("lon"))
    d = i.occ.groupBy("presence").agg(*geo.padded_extent_aggs(x, y))
    return d.select("presence", *[rnd(c, 3) for c in ("xmin", "xmax", "ymin", "ymax")])


@query(
    "A18_occurrence_qa", ["occ"],
    """SELECT species, count(*) AS n_rows, count(DISTINCT (lat, lon)) AS n_places, round(min(coordinate_uncertainty_m), 6) AS unc_min,
 round(median(coordinate_uncertainty_m), 6) AS unc_median, round(max(coordinate_uncertainty_m), 6) AS unc_max FROM occ GROUP BY species""",
)
def occurrence_qa(i: Inputs):
    d = splits.occurrence_qa(i.occ, ["species"])
    return d.select("species", "n_rows", "n_places", rnd("unc_min"), rnd("unc_median"), rnd("unc_max"))


@query("A18_source_counts", ["occ"], "SELECT species, source, count(*) AS n FROM occ GROUP BY 1, 2")
def source_counts(i: Inputs):
    return splits.source_counts(i.occ, ["species"])


@query(
    "text_functions", ["documents"],
    """SELECT doc_id, trim(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '_') AS slug, lower(source) IN ('true', '1', 'yes', 'y', 't') AS flag,
 regexp_extract(concat('d/', source, '\\', lang, '.csv'), '[^/\\\\]+$') AS base, sha1(concat(source, lang))[1:10] AS short_hash FROM documents""",
)
def text_functions(i: Inputs):
    path = F.concat(F.lit("d/"), F.col("source"), F.lit("\\"), F.col("lang"), F.lit(".csv"))
    return i.documents.select(
        "doc_id", text.slug(F.col("text")).alias("slug"), text.to_bool(F.col("source")).alias("flag"),
        text.base_name(path).alias("base"), F.substring(F.sha1(F.concat("source", "lang")), 1, 10).alias("short_hash"),
    )


@query("general_number_text", ["events"], "SELECT event_id, format('{:g}', value * 1000) AS wide, format('{:.2g}', value / 100000) AS small FROM events")
def general_number_text(i: Inputs):
    v = F.col("value")
    return i.events.select("event_id", text.general_number(v * 1000, 6).alias("wide"), text.general_number(v / 100000, 2).alias("small"))
