"""Deduplication, joins, thinning, background, splits and folds (J*, D*, F*, U*, L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import sampling as s
from ...operators import spatial, splits
from ...operators.ranks import exact_rank
from ..registry import Inputs, query
from .common import CELL_SQL, GRID, SEED, albers_inverse_sql, albers_sql, rnd, uniform_sql

SP = ["species"]
_CELL = CELL_SQL.format(a="")

# One record per coordinate, then per raster cell, smallest order key first.
_THIN = f"""WITH dd AS (SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY species, lat, lon ORDER BY order_key) = 1),
 cc AS (SELECT *, {_CELL} FROM dd),
 pres AS (SELECT *, {albers_sql()} FROM cc QUALIFY row_number() OVER (PARTITION BY species, cell_row, cell_col ORDER BY order_key) = 1)
"""


def cell_thinned(i: Inputs):
    """Occurrences after exact and raster-cell deduplication."""
    return s.thin_to_cell(s.dedup_latlon(i.occ, SP, "order_key"), GRID, SP, "order_key")


@query("D1_dedup_latlon", ["occ"], _THIN + "SELECT species, lat, lon, occ_id FROM dd")
def dedup_latlon(i: Inputs):
    return s.dedup_latlon(i.occ, SP, "order_key").select("species", "lat", "lon", "occ_id")


@query("D2_thin_to_cell", ["occ"], _THIN + "SELECT species, cell_row, cell_col, occ_id FROM pres")
def thin_to_cell(i: Inputs):
    return cell_thinned(i).select("species", "cell_row", "cell_col", "occ_id")


@query("D3_cap_presences", ["occ"], "SELECT species, occ_id FROM occ QUALIFY row_number() OVER (PARTITION BY species ORDER BY order_key) <= 250")
def cap_presences(i: Inputs):
    return s.cap_presences(i.occ, 250, SP, "order_key").select("species", "occ_id")


@query("L4_exact_rank", ["occ"], "SELECT occ_id, row_number() OVER (PARTITION BY presence ORDER BY order_key) - 1 AS rank FROM occ")
def rank(i: Inputs):
    return exact_rank(i.occ, ["presence"], "order_key").select("occ_id", "rank")


@query("D8_dedup_points", ["occ"], "SELECT lat, lon, presence, occ_id FROM occ QUALIFY row_number() OVER (PARTITION BY lat, lon, presence ORDER BY order_key) = 1")
def dedup_points(i: Inputs):
    return s.dedup_points(i.occ, [], "order_key").select("lat", "lon", "presence", "occ_id")


@query(
    "J1_pairs_within", ["occ"],
    _THIN + f""", pts AS (SELECT occ_id, species, {albers_sql()} FROM occ),
 b AS (SELECT *, CAST(floor(x / 800) AS BIGINT) AS bx, CAST(floor(y / 800) AS BIGINT) AS by FROM pts),
 n AS (SELECT species, occ_id, x, y, CAST(floor(x / 800) AS BIGINT) + ox AS bx, CAST(floor(y / 800) AS BIGINT) + oy AS by FROM pres, (VALUES (-1),(0),(1)) o(ox), (VALUES (-1),(0),(1)) q(oy))
 SELECT b.occ_id, n.occ_id AS c_occ_id FROM b JOIN n ON b.species = n.species AND b.bx = n.bx AND b.by = n.by
 WHERE (b.x - n.x) * (b.x - n.x) + (b.y - n.y) * (b.y - n.y) <= 640000""",
)
def pairs_within(i: Inputs):
    pts, centres = s.with_albers(i.occ), s.with_albers(cell_thinned(i))
    return s.neighbours_within(pts, centres, SP, "occ_id", 800.0).select("occ_id", "c_occ_id")


@query(
    "J2_nearest_presence", ["occ"],
    _THIN + f""", a AS (SELECT occ_id, {albers_sql()} FROM occ WHERE presence = 0), p AS (SELECT x, y FROM pres WHERE presence = 1)
 SELECT a.occ_id, round(min(sqrt((a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y))) / 1000, 6) AS nearest_presence_km FROM a, p GROUP BY a.occ_id""",
)
def nearest_presence(i: Inputs):
    pts = s.with_albers(i.occ.filter("presence = 0")).withColumn("g", F.lit(0))
    near = s.with_albers(cell_thinned(i).filter("presence = 1")).withColumn("g", F.lit(0))
    d = s.nearest_presence(pts, s.as_centres(near, ["g"]), ["g"], "occ_id", 2000.0, 4_000_000.0)
    return d.select("occ_id", rnd("nearest_presence_km"))


@query(
    "J3_attach_tile", ["occ", "tile_idx"],
    """SELECT occ_id, min(tile_id) AS tile_id, min_by(filename, tile_id) AS filename, min_by(url, tile_id) AS url FROM occ LEFT JOIN tile_idx
 ON lon > minx AND lon < maxx AND lat > miny AND lat < maxy GROUP BY occ_id""",
)
def attach_tile(i: Inputs):
    return spatial.attach_tile(i.occ, i.tile_idx, "occ_id").select("occ_id", "tile_id", "filename", "url")


_IN_RING = """WITH c AS (SELECT occ_id, t.tile_id, count(*) FILTER (((ay > lat) <> (byy > lat)) AND lon < ax + (lat - ay) / nullif(byy - ay, 0) * (bx - ax)) % 2 AS odd
  FROM {src} JOIN tile_idx t ON lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy JOIN tile_edge e ON e.tile_id = t.tile_id {where} GROUP BY 1, 2),
 h AS (SELECT occ_id, min(tile_id) AS tile_id FROM c WHERE odd = 1 GROUP BY occ_id)
"""


def ring_cover(i: Inputs, tiles=None):
    """Cell cover of the tile outlines."""
    edges = i.tile_edge if tiles is None else i.tile_edge.join(tiles.select("tile_id"), "tile_id", "left_semi")
    return spatial.ring_cover(edges.withColumnRenamed("byy", "by"))


@query("J3_attach_ring_tile", ["occ", "tile_idx", "tile_edge"], _IN_RING.format(src="occ", where="") + "SELECT occ_id, tile_id, filename, url FROM occ LEFT JOIN h USING (occ_id) LEFT JOIN tile_idx USING (tile_id)")
def attach_ring_tile(i: Inputs):
    return spatial.attach_ring_tile(i.occ, i.tile_idx, ring_cover(i), "occ_id").select("occ_id", "tile_id", "filename", "url")


@query("J12_in_ring_footprint", ["occ", "tile_idx", "tile_edge"], _IN_RING.format(src="occ", where="WHERE downloaded") + "SELECT occ_id FROM h")
def in_ring_footprint(i: Inputs):
    return spatial.in_ring_footprint(i.occ, ring_cover(i, i.tile_idx.filter("downloaded")), "occ_id").select("occ_id")


@query("J4_tile_downloaded", ["tile_idx"], "SELECT tile_id, lower(regexp_extract(filename, '[^/]+$')) AS filename_lower, downloaded FROM tile_idx")
def tile_downloaded(i: Inputs):
    files = i.tile_idx.filter("downloaded").select(F.lower("filename").alias("path"))
    return spatial.tile_downloaded(i.tile_idx.drop("downloaded"), files).select("tile_id", "filename_lower", "downloaded")


@query(
    "J5_not_in_presence_cell", ["occ"],
    f"WITH c AS (SELECT *, {_CELL} FROM occ) SELECT occ_id FROM c WHERE presence = 0 AND (cell_row, cell_col) NOT IN (SELECT (cell_row, cell_col) FROM c WHERE presence = 1)",
)
def not_in_presence_cell(i: Inputs):
    d = s.with_cell(i.occ, GRID)
    return s.not_in_presence_cell(d.filter("presence = 0"), d.filter("presence = 1"), [], "occ_id").select("occ_id")


@query(
    "J10_reattach_fold", ["occ"],
    "SELECT occ_id, CAST(user_id % 5 AS INTEGER) AS fold, CAST(user_id AS VARCHAR) AS block_id FROM (SELECT occ_id, lat, lon FROM occ) a JOIN (SELECT DISTINCT lat, lon, user_id FROM occ) b USING (lat, lon)",
)
def reattach_fold(i: Inputs):
    pts = i.occ.withColumn("fold", (F.col("user_id") % 5).cast("int")).withColumn("block_id", F.col("user_id").cast("string"))
    return splits.reattach_fold(i.occ.select("occ_id", "lat", "lon"), pts, []).select("occ_id", "fold", "block_id")


@query(
    "J11_in_annulus", ["occ"],
    _THIN + f""", a AS (SELECT occ_id, species, {albers_sql()} FROM occ WHERE presence = 0), p AS (SELECT x, y FROM pres WHERE presence = 1),
 m AS (SELECT a.occ_id, min((a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y)) AS d2 FROM a, p GROUP BY a.occ_id)
 SELECT occ_id FROM m WHERE d2 <= 100000000 AND d2 >= 1000000""",
)
def in_annulus(i: Inputs):
    pts = s.with_albers(i.occ.filter("presence = 0")).withColumn("g", F.lit(0))
    near = s.with_albers(cell_thinned(i).filter("presence = 1")).withColumn("g", F.lit(0))
    return s.in_annulus(pts, s.as_centres(near, ["g"]), ["g"], "occ_id", 1000.0, 10000.0).select("occ_id")


@query(
    "J12_in_footprint", ["occ", "tile_idx"],
    "SELECT occ_id FROM occ WHERE EXISTS (SELECT 1 FROM tile_idx WHERE downloaded AND lon >= minx AND lon <= maxx AND lat >= miny AND lat <= maxy)",
)
def in_footprint(i: Inputs):
    return spatial.in_footprint(i.occ, i.tile_idx.filter("downloaded"), "occ_id").select("occ_id")


@query(
    "G11_sampling_area", ["occ"],
    _THIN + f""", p AS (SELECT x, y FROM pres WHERE presence = 1),
 l AS (SELECT DISTINCT (CAST(floor(x / 5000) AS BIGINT) + ox) AS gx, (CAST(floor(y / 5000) AS BIGINT) + oy) AS gy FROM p, generate_series(-4, 4) o(ox), generate_series(-4, 4) q(oy)),
 m AS (SELECT gx, gy, min(((gx + 0.5) * 5000 - x) * ((gx + 0.5) * 5000 - x) + ((gy + 0.5) * 5000 - y) * ((gy + 0.5) * 5000 - y)) AS d2 FROM l, p GROUP BY gx, gy)
 SELECT CAST(count(*) AS DOUBLE) * 25 AS area_km2 FROM m WHERE d2 <= 225000000 AND d2 >= 4000000""",
)
def sampling_area(i: Inputs):
    near = s.with_albers(cell_thinned(i).filter("presence = 1")).withColumn("g", F.lit(0))
    return spatial.sampling_area_km2(near, ["g"], 2000.0, 15000.0, 5000.0).select("area_km2")


def _greedy_sql(rounds: int = 14) -> str:
    """Greedy thinning written as unrolled rounds over the pair list."""
    q = [
        f"WITH p AS (SELECT occ_id, order_key AS k, {albers_sql()} FROM occ)",
        "b AS (SELECT *, CAST(floor(x / 800) AS BIGINT) AS gx, CAST(floor(y / 800) AS BIGINT) AS gy FROM p)",
        "n AS (SELECT occ_id, k, x, y, gx + ox AS gx, gy + oy AS gy FROM b, (VALUES (-1),(0),(1)) o(ox), (VALUES (-1),(0),(1)) q(oy))",
        "e AS MATERIALIZED (SELECT b.occ_id AS a, n.occ_id AS c, n.k < b.k AS c_first FROM b JOIN n ON b.gx = n.gx AND b.gy = n.gy AND b.occ_id <> n.occ_id"
        " AND (b.x - n.x) * (b.x - n.x) + (b.y - n.y) * (b.y - n.y) <= 640000)",
        "u0 AS MATERIALIZED (SELECT occ_id FROM p)",
    ]
    for r in range(rounds):
        q.append(
            f"k{r} AS MATERIALIZED (SELECT occ_id FROM u{r} WHERE occ_id NOT IN (SELECT a FROM e WHERE c_first AND c IN (SELECT occ_id FROM u{r})))"
        )
        q.append(
            f"u{r + 1} AS MATERIALIZED (SELECT occ_id FROM u{r} WHERE occ_id NOT IN (SELECT occ_id FROM k{r}) AND occ_id NOT IN (SELECT a FROM e WHERE c IN (SELECT occ_id FROM k{r})))"
        )
    kept = " UNION ALL ".join(f"SELECT occ_id FROM k{r}" for r in range(rounds))
    return ",\n ".join(q) + f"\nSELECT occ_id, CAST(800 AS DOUBLE) AS spatial_thin_distance_m FROM ({kept}) t"


@query("D7_spatial_thin", ["occ"], _greedy_sql())
def spatial_thin(i: Inputs):
    pts = s.with_albers(i.occ).withColumn("g", F.lit(0))
    return s.spatial_thin(pts, ["g"], "occ_id", "order_key", 800.0).select("occ_id", "spatial_thin_distance_m")


# Background rounds: draws, acceptance, pooling until every species has enough cells.
def _background_sql(place: str, accept: str, factor: float, rule: str, rounds: int = 4) -> str:
    draws = " UNION ALL ".join(
        f"SELECT {r} AS round, species, n, draw, md5(concat('{SEED + r}:', species, ':', draw)) AS dk FROM (SELECT species, n, unnest(range(CAST(ceil(n * {factor}) AS BIGINT))) AS draw FROM size) q{r}"
        for r in range(rounds)
    )
    return (
        _THIN
        + f""", size AS (SELECT species, count(*) AS n FROM pres GROUP BY species),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY order_key) - 1 AS rk FROM pres),
 d AS ({draws}),
 {place},
 ok AS MATERIALIZED ({accept}),
 oc AS (SELECT *, {_CELL} FROM ok),
 free AS (SELECT * FROM oc WHERE NOT EXISTS (SELECT 1 FROM pres WHERE pres.species = oc.species AND pres.cell_row = oc.cell_row AND pres.cell_col = oc.cell_col)),
 got AS (SELECT f.species, r.round, count(DISTINCT (cell_row, cell_col)) AS have FROM free f JOIN (SELECT unnest(range({rounds})) AS round) r ON f.round <= r.round GROUP BY 1, 2),
 stop AS (SELECT got.species, min(got.round) AS last, any_value(n) AS n FROM got JOIN size USING (species) WHERE have >= n GROUP BY got.species),
 pool AS (SELECT free.*, stop.n AS want FROM free JOIN stop ON free.species = stop.species AND free.round <= stop.last
   QUALIFY row_number() OVER (PARTITION BY free.species, cell_row, cell_col ORDER BY dk) = 1),
 fin AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY species ORDER BY md5(concat('{SEED}:', dk))) <= want),
 near AS (SELECT fin.dk, min((fin.x - p.x) * (fin.x - p.x) + (fin.y - p.y) * (fin.y - p.y)) AS d2 FROM fin JOIN pres p ON p.species = fin.species GROUP BY fin.dk)
 SELECT species, dk AS draw_key, round(lat, 6) AS lat, round(lon, 6) AS lon, cell_row, cell_col, round(sqrt(d2) / 1000, 5) AS nearest_presence_km, 'background' AS source, '{rule}' AS background_sampling_rule
 FROM fin JOIN near USING (dk)"""
    )


_RADIAL_PLACE = f"""c0 AS (SELECT d.round, d.species, d.dk, r.x AS ox, r.y AS oy, {uniform_sql('d.dk', 1)} * 6.283185307179586 AS ang,
   sqrt({uniform_sql('d.dk', 2)} * (50000.0*50000.0 - 5000.0*5000.0) + 5000.0*5000.0) AS dist
   FROM d JOIN ranked r ON r.species = d.species AND r.rk = CAST(floor({uniform_sql('d.dk', 0)} * d.n) AS BIGINT)),
 c1 AS (SELECT round, species, dk, ox + dist * cos(ang) AS x, oy + dist * sin(ang) AS y FROM c0),
 c2 AS (SELECT *, {albers_inverse_sql('x', 'y')} FROM c1),
 bp AS (SELECT species, x, y, CAST(floor(x / 5000) AS BIGINT) + ux AS bx, CAST(floor(y / 5000) AS BIGINT) + uy AS by FROM pres, (VALUES (-1),(0),(1)) o(ux), (VALUES (-1),(0),(1)) q(uy)),
 bad AS (SELECT DISTINCT c2.dk FROM c2 JOIN bp ON bp.species = c2.species AND bp.bx = CAST(floor(c2.x / 5000) AS BIGINT) AND bp.by = CAST(floor(c2.y / 5000) AS BIGINT)
   WHERE (c2.x - bp.x) * (c2.x - bp.x) + (c2.y - bp.y) * (c2.y - bp.y) < 25000000)"""


@query(
    "D4_background_radial", ["occ"],
    _background_sql(_RADIAL_PLACE, "SELECT * FROM c2 WHERE dk NOT IN (SELECT dk FROM bad)", 3.0, "radial_doughnut_5_50_km"),
)
def background_radial(i: Inputs):
    d = s.background_radial(cell_thinned(i), SP, "order_key", GRID, 50.0, 5.0, 3.0, seed=SEED)
    return _background_out(d)


def _background_out(d):
    return d.select(
        "species", "draw_key", rnd("lat"), rnd("lon"), "cell_row", "cell_col", rnd("nearest_presence_km", 5), "source", "background_sampling_rule"
    )


_POLY_PLACE = f"""zm AS (SELECT species, min(lon) AS lon1, max(lon) AS lon2, min(lat) AS lat1, max(lat) AS lat2, greatest(abs(max(lat)), abs(min(lat))) + CAST(50000.0 AS DOUBLE) / 110000.0 AS m FROM pres GROUP BY species),
 zw AS (SELECT *, CAST(50000.0 AS DOUBLE) / (CAST(110000.0 AS DOUBLE) * greatest(CAST(1.0 AS DOUBLE) - CAST(0.00015231 AS DOUBLE) * m * m, CAST(1.0 AS DOUBLE) - m / 90.0, CAST(0.001 AS DOUBLE))) AS px FROM zm),
 zb AS (SELECT species, lon1 - px AS x1, lon2 + px AS x2, lat1 - 50000.0 / 110000.0 AS y1, lat2 + 50000.0 / 110000.0 AS y2 FROM zw),
 c0 AS (SELECT d.round, d.species, d.dk, zb.x1 + {uniform_sql('d.dk', 0)} * (zb.x2 - zb.x1) AS lon, zb.y1 + {uniform_sql('d.dk', 1)} * (zb.y2 - zb.y1) AS lat FROM d JOIN zb USING (species)),
 c1 AS (SELECT *, {albers_sql()} FROM c0 WHERE EXISTS (SELECT 1 FROM tile_idx t WHERE t.downloaded AND c0.lon >= t.minx AND c0.lon <= t.maxx AND c0.lat >= t.miny AND c0.lat <= t.maxy)),
 bp AS (SELECT species, x, y, CAST(floor(x / 50000) AS BIGINT) + ux AS bx, CAST(floor(y / 50000) AS BIGINT) + uy AS by FROM pres, (VALUES (-1),(0),(1)) o(ux), (VALUES (-1),(0),(1)) q(uy)),
 nn AS (SELECT c1.dk, min((c1.x - bp.x) * (c1.x - bp.x) + (c1.y - bp.y) * (c1.y - bp.y)) AS d2 FROM c1 JOIN bp ON bp.species = c1.species
   AND bp.bx = CAST(floor(c1.x / 50000) AS BIGINT) AND bp.by = CAST(floor(c1.y / 50000) AS BIGINT) GROUP BY c1.dk)"""


@query(
    "D5_background_polygon", ["occ", "tile_idx"],
    _background_sql(_POLY_PLACE, "SELECT c1.* FROM c1 JOIN nn USING (dk) WHERE d2 <= 2500000000 AND d2 >= 25000000", 15.0, "doughnut_5_50_km", 10),
)
def background_polygon(i: Inputs):
    tiles = i.tile_idx.filter("downloaded")
    d = s.background_polygon(
        cell_thinned(i), SP, "order_key", GRID, 50.0, 5.0, 3.0, 5.0, seed=SEED,
        footprint=lambda p: spatial.in_footprint(p, tiles, "draw_key"),
    )
    return _background_out(d)


@query(
    "D6_background_exact_n", ["occ"],
    _THIN + "SELECT species, count(*) AS n, count(*) AS n_cells, 'radial_doughnut_0_25_km' AS background_sampling_rule FROM pres GROUP BY species",
)
def background_exact_n(i: Inputs):
    d = s.background_radial(cell_thinned(i), SP, "order_key", GRID, 25.0, 0.0, 3.0, seed=SEED)
    cells = d.groupBy("species", "background_sampling_rule", "cell_row", "cell_col").agg(F.count(F.lit(1)).alias("k"))
    return cells.groupBy("species", "background_sampling_rule").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_cells"))


@query(
    "D9_random_points", ["supplier"],
    f"""WITH d AS (SELECT s_suppkey, unnest(range(40)) AS draw FROM supplier), k AS (SELECT *, md5(concat('42:', s_suppkey, ':', draw)) AS dk FROM d),
 p AS (SELECT s_suppkey, dk AS draw_key, -120.0 + {uniform_sql('dk', 0)} * 30.0 AS px, 30.0 + {uniform_sql('dk', 1)} * 10.0 AS py FROM k)
 SELECT s_suppkey, draw_key, round(px, 6) AS px, round(py, 6) AS py FROM p WHERE (py - 30) / 10 + (px + 120) / 30 < 1
 QUALIFY row_number() OVER (ORDER BY draw_key) <= 15 * (SELECT count(*) FROM supplier)""",
)
def random_points(i: Inputs):
    from ...functions.geo import point_in_ring

    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-120.0, 30.0), (-90.0, 30.0), (-120.0, 40.0))])
    d = s.random_points(i.supplier, "s_suppkey", 40, (-120.0, 30.0, -90.0, 40.0), lambda x, y: point_in_ring(x, y, ring), SEED, 15 * i.supplier.count())
    return d.select("s_suppkey", "draw_key", rnd("px"), rnd("py"))


@query(
    "A20_distance_summary", ["occ"],
    _THIN + f""", a AS (SELECT species, occ_id, {albers_sql()} FROM occ WHERE presence = 0), p AS (SELECT x, y FROM pres WHERE presence = 1),
 m AS (SELECT species, occ_id, sqrt(min((a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y))) / 1000 AS km FROM a, p GROUP BY 1, 2)
 SELECT species, round(min(km), 5) AS min_km, round(median(km), 5) AS median_km, round(max(km), 5) AS max_km FROM m GROUP BY species""",
)
def distance_summary(i: Inputs):
    pts = s.with_albers(i.occ.filter("presence = 0")).withColumn("g", F.lit(0))
    near = s.with_albers(cell_thinned(i).filter("presence = 1")).withColumn("g", F.lit(0))
    d = s.nearest_presence(pts, s.as_centres(near, ["g"]), ["g"], "occ_id", 2000.0, 4_000_000.0)
    return splits.distance_summary(d, SP).select("species", *[rnd(c, 5) for c in ("min_km", "median_km", "max_km")])


_SPLIT = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY species, presence ORDER BY order_key) - 1 AS rk, CAST(count(*) OVER (PARTITION BY species, presence) AS DOUBLE) AS n FROM occ)
"""


@query(
    "F1_stratified_split", ["occ"],
    _SPLIT + "SELECT occ_id, CASE WHEN rk < round_even(n * 0.7, 0) THEN 'train' WHEN rk < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM n",
)
def stratified_split(i: Inputs):
    return splits.stratified_split(i.occ, SP, "order_key", 0.70, 0.15).select("occ_id", "split")


_BLOCK = f"""WITH p AS (SELECT *, {albers_sql()} FROM occ), m AS (SELECT species, min(x) AS x0, min(y) AS y0 FROM p GROUP BY species),
 b AS (SELECT p.*, CAST(floor((x - x0) / 200000) AS INTEGER) AS block_x, CAST(floor((y - y0) / 200000) AS INTEGER) AS block_y FROM p JOIN m USING (species)),
 k AS (SELECT *, concat(block_x, '_', block_y) AS block_id FROM b),
 f AS (SELECT species, block_id, CAST((row_number() OVER (PARTITION BY species ORDER BY md5(concat('42:', block_id))) - 1) % 5 + 1 AS INTEGER) AS fold FROM (SELECT DISTINCT species, block_id FROM k) u)
"""


def folded(i: Inputs):
    """Occurrences with 200 km blocks and five folds per species."""
    return splits.assign_folds(splits.spatial_blocks(s.with_albers(i.occ), SP, 200000.0), SP, 5, SEED)


@query("F2_spatial_blocks", ["occ"], _BLOCK + "SELECT occ_id, block_x, block_y, block_id FROM k")
def spatial_blocks(i: Inputs):
    return splits.spatial_blocks(s.with_albers(i.occ), SP, 200000.0).select("occ_id", "block_x", "block_y", "block_id")


@query("F3_assign_folds", ["occ"], _BLOCK + "SELECT species, block_id, fold FROM f")
def assign_folds(i: Inputs):
    return splits.fold_map(splits.spatial_blocks(s.with_albers(i.occ), SP, 200000.0), SP, 5, SEED)


@query("J9_block_fold", ["occ"], _BLOCK + "SELECT species, fold, count(*) AS n, sum(presence)::BIGINT AS n_presence FROM k JOIN f USING (species, block_id) GROUP BY 1, 2")
def block_fold(i: Inputs):
    return folded(i).groupBy("species", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("presence").alias("n_presence"))


def _cv_sql(rest: str) -> str:
    return (
        _BLOCK
        + f""", r AS (SELECT occ_id, species, presence, order_key, fold, unnest(range(1, 6)) AS cv_round FROM k JOIN f USING (species, block_id)),
 n AS (SELECT *, row_number() OVER w - 1 AS rk, CAST(count(*) OVER (PARTITION BY species, cv_round, presence, fold = cv_round) AS DOUBLE) AS n FROM r
   WINDOW w AS (PARTITION BY species, cv_round, presence, fold = cv_round ORDER BY order_key))
 SELECT occ_id, CAST(cv_round AS INTEGER) AS cv_round, fold, CASE WHEN fold = cv_round THEN 'test' WHEN rk < round_even(n * 0.7, 0) THEN 'train' WHEN rk < round_even(n * 0.7, 0) + round_even(n * 0.3, 0) THEN 'val' ELSE '{rest}' END AS split FROM n"""
    )


@query("F4_cv_rounds", ["occ"], _cv_sql("val"))
def cv_rounds(i: Inputs):
    return splits.cv_rounds(folded(i), SP, "order_key", 5).select("occ_id", "cv_round", "fold", "split")


@query("F4_cv_rounds_legacy", ["occ"], _cv_sql("test"))
def cv_rounds_legacy(i: Inputs):
    return splits.cv_rounds(folded(i), SP, "order_key", 5, legacy_remainder=True).select("occ_id", "cv_round", "fold", "split")


@query(
    "F5_sample_ids", ["occ"],
    """WITH n AS (SELECT occ_id, presence, CASE WHEN user_id % 3 = 0 THEN 'val' ELSE 'train' END AS split, row_number() OVER (PARTITION BY species ORDER BY order_key) - 1 AS rk FROM occ)
 SELECT occ_id, concat(rk, '_', presence, '_', split) AS sample_id, concat('images/chip_', rk, CASE WHEN presence = 1 THEN '_pres_' ELSE '_abs_' END, split) AS chip_path FROM n""",
)
def sample_ids(i: Inputs):
    d = i.occ.withColumn("split", F.when(F.col("user_id") % 3 == 0, "val").otherwise("train"))
    return splits.sample_ids(d, SP, "order_key").select("occ_id", "sample_id", "chip_path")


@query(
    "F6_norm_latlon", ["occ"],
    """SELECT occ_id, round((lat - avg(lat) OVER w) / stddev_samp(lat) OVER w, 6) AS lat_norm, round((lon - avg(lon) OVER w) / stddev_samp(lon) OVER w, 6) AS lon_norm FROM occ WINDOW w AS (PARTITION BY species)""",
)
def norm_latlon(i: Inputs):
    return splits.norm_latlon(i.occ, SP).select("occ_id", rnd("lat_norm"), rnd("lon_norm"))


@query(
    "U1_union_points", ["occ"],
    "SELECT presence, count(*) AS n, count(coordinate_uncertainty_m) FILTER (presence = 1) AS n_unc, CASE WHEN presence = 0 THEN count(*) ELSE 0 END AS n_rule FROM occ GROUP BY presence",
)
def union_points(i: Inputs):
    p = i.occ.filter("presence = 1").select("species", "lat", "lon", "coordinate_uncertainty_m")
    b = i.occ.filter("presence = 0").select("species", "lat", "lon", F.lit("rule").alias("background_sampling_rule"))
    u = splits.union_points(p, b)
    return u.groupBy("presence").agg(
        F.count(F.lit(1)).alias("n"), F.count("coordinate_uncertainty_m").alias("n_unc"), F.count("background_sampling_rule").alias("n_rule")
    )


@query("U2_union_rounds", ["occ"], _BLOCK + "SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS cv_round, count(*) AS n FROM k GROUP BY 1")
def union_rounds(i: Inputs):
    return splits.cv_rounds(folded(i), SP, "order_key", 5).groupBy("cv_round").agg(F.count(F.lit(1)).alias("n"))


@query("U3_union_candidates", ["occ"], f"WITH c AS (SELECT *, {_CELL} FROM occ) SELECT cell_row, cell_col, min(order_key) AS order_key FROM c GROUP BY 1, 2")
def union_candidates(i: Inputs):
    d = s.with_cell(i.occ, GRID).select("cell_row", "cell_col", "order_key", "presence")
    pooled = d.filter("presence = 1").unionByName(d.filter("presence = 0"))
    return s.first_by(pooled, ["cell_row", "cell_col"], "order_key").select("cell_row", "cell_col", "order_key")
