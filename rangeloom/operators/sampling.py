"""Deduplication, cell thinning, background sampling and distance thinning.

`by` names the key columns (usually species) that keep many data sets apart in one job.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import albers_inverse, albers_xy, annulus_offset, cell_row_col
from ..functions.keys import order_key, uniform
from ..session import materialize
from .joins import grid_join, salted_join, same_keys_join
from .ranks import exact_rank

Grid = tuple[float, float, float, float]


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest `order` per key; partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def dedup_latlon(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """One record per exact coordinate."""
    return first_by(df, [*by, "lat", "lon"], order)


def dedup_points(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """One record per coordinate and class, after a tile join may have repeated points."""
    return first_by(df, [*by, "lat", "lon", "presence"], order)


def with_cell(df: DataFrame, grid: Grid) -> DataFrame:
    """Raster cell of each point as two integers."""
    r, c = cell_row_col(F.col("lat"), F.col("lon"), *grid)
    return df.withColumn("cell_row", r).withColumn("cell_col", c)


def thin_to_cell(df: DataFrame, grid: Grid, by: list[str], order: str) -> DataFrame:
    """One record per raster cell, chosen by the seeded order key."""
    return first_by(with_cell(df, grid), [*by, "cell_row", "cell_col"], order)


def cap_presences(df: DataFrame, n: int, by: list[str], order: str) -> DataFrame:
    """Seeded sample of `n` per group."""
    return exact_rank(df, by, order, "_rk").filter(F.col("_rk") < n).drop("_rk")


def with_albers(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Projected metres of `lat, lon`."""
    px, py = albers_xy(F.col("lat"), F.col("lon"))
    return df.withColumn(x, px).withColumn(y, py)


def as_centres(df: DataFrame, by: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rename projected points for the centre side of a grid join."""
    return df.select(*by, F.col("x").alias("c_x"), F.col("y").alias("c_y"), *[F.col(k).alias(f"c_{k}") for k in keep or []])


def _cells(df: DataFrame, by: list[str], x: str, y: str, side: float, levels: int) -> DataFrame:
    """Occupied squares of a tree over the points: `lvl`, `cx, cy` and the bounds of what lies in them.

    Level `levels` has squares of `side`; each level above has four times that. Points without a place are in no square.
    """
    leaf = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy"))
    leaf = leaf.agg(F.min(x).alias("x1"), F.max(x).alias("x2"), F.min(y).alias("y1"), F.max(y).alias("y2"))
    up = leaf.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    up = up.withColumns({c: F.expr(f"shiftright({c}, 2 * ({levels} - lvl))") for c in ("cx", "cy")})
    return up.groupBy("lvl", *by, "cx", "cy").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))


def _gap(axis: str) -> Column:
    """Distance along an axis between the bounds of a square of points (p_) and one of centres (q_)."""
    return F.greatest(F.col(f"q_{axis}1") - F.col(f"p_{axis}2"), F.col(f"p_{axis}1") - F.col(f"q_{axis}2"), F.lit(0.0))


def _span(axis: str) -> Column:
    return F.greatest(F.col(f"q_{axis}2") - F.col(f"p_{axis}1"), F.col(f"p_{axis}2") - F.col(f"q_{axis}1"))


#: Relative room for rounding when bounds of distances are compared.
_SLACK = 1 + 1e-9


def _nearest_squares(points: DataFrame, centres: DataFrame, by: list[str], side: float, levels: int, outer_m: float) -> DataFrame:
    """Pairs of leaf squares that may hold a point and its nearest centre, with `bound`: no point's nearest is farther.

    From the squares of the outer radius down, both sides are cut in sixteen; a pair goes as soon as its smallest distance
    exceeds the largest one of another pair of the same points. What is left per square of points is a ring of squares.
    """
    p, q = (materialize(_cells(d, by, x, y, side, levels), n) for d, x, y, n in ((points, "x", "y", "point_squares"), (centres, "c_x", "c_y", "centre_squares")))
    box = ["cx", "cy", "x1", "x2", "y1", "y2"]
    pairs = None
    for lvl in range(levels + 1):
        pl = p.filter(F.col("lvl") == lvl).select(*by, *[F.col(c).alias(f"p_{c}") for c in box])
        ql = q.filter(F.col("lvl") == lvl).select(*[F.col(k).alias(f"q_{k}") for k in by], *[F.col(c).alias(f"q_{c}") for c in box])
        same = F.lit(True)
        for k in by:
            same = same & (F.col(k) == F.col(f"q_{k}"))
        if pairs is None:
            near = F.sequence(F.lit(-1), F.lit(1))
            ql = ql.withColumn("_x", F.explode(near)).withColumn("_y", F.explode(near))
            on = same & (F.col("p_cx") == F.col("q_cx") + F.col("_x")) & (F.col("p_cy") == F.col("q_cy") + F.col("_y"))
            pairs = pl.join(ql, on).drop("_x", "_y", *[f"q_{k}" for k in by])
        else:
            up = pairs.select(*by, *[F.col(f"{s}_{c}").alias(f"_{s}{c}") for s in "pq" for c in ("cx", "cy")])
            pl = pl.withColumns({"_pcx": F.shiftright("p_cx", 2), "_pcy": F.shiftright("p_cy", 2)})
            ql = ql.withColumns({"_qcx": F.shiftright("q_cx", 2), "_qcy": F.shiftright("q_cy", 2)}).withColumnsRenamed({f"q_{k}": k for k in by})
            pairs = up.join(pl, [*by, "_pcx", "_pcy"]).join(ql, [*by, "_qcx", "_qcy"]).drop("_pcx", "_pcy", "_qcx", "_qcy")
        lo, hi = (F.sqrt(f("x") * f("x") + f("y") * f("y")) for f in (_gap, _span))
        # The pairs of one square of points are a bounded group.
        w = W.partitionBy(*by, "p_cx", "p_cy")
        # The next level takes its bounds from the squares, so only the last one carries those of the points along.
        keep = [*by, "p_cx", "p_cy", "q_cx", "q_cy", *([f"p_{c}" for c in box[2:]] if lvl == levels else [])]
        pairs = pairs.select(*keep, lo.alias("_lo"), hi.alias("_hi"))
        pairs = pairs.withColumn("bound", F.least(F.min("_hi").over(w) * _SLACK, F.lit(float(outer_m))))
        pairs = pairs.filter(F.col("_lo") <= F.col("bound")).select(*keep, *(["bound"] if lvl == levels else []))
        if lvl % 3 == 2 or lvl == levels:
            pairs = materialize(pairs, "square_pairs")
    return pairs


def nearest_presence(points: DataFrame, centres: DataFrame, by: list[str], ident: str, start_m: float, outer_m: float) -> DataFrame:
    """Distance in km from each point to its nearest centre within `outer_m`; NULL beyond.

    Two trees of squares, down to about `start_m`, are searched in pairs; points meet only the centres of
    the leaf squares that the bounds leave, so neither dense nor empty areas cause a wide search.
    """
    levels = max(0, math.ceil(math.log(outer_m / min(start_m, outer_m), 4) - 0.25))
    side = outer_m / 4**levels
    # Both sides are read several times: as narrow rows, stored once.
    near = materialize(points.select(*by, ident, "x", "y"), "points")
    centres = materialize(centres.select(*by, "c_x", "c_y"), "centres")
    # Squares of the outer radius: every centre within it lies in the square of the point or next to it.
    pairs = _nearest_squares(near, centres, by, side, levels, outer_m)
    c = centres.withColumns({"q_cx": F.floor(F.col("c_x") / side), "q_cy": F.floor(F.col("c_y") / side)})
    c = salted_join(pairs, c, [*by, "q_cx", "q_cy"], "inner", "p_cx")
    gx, gy = (F.greatest(F.col(f"c_{a}") - F.col(f"p_{a}2"), F.col(f"p_{a}1") - F.col(f"c_{a}"), F.lit(0.0)) for a in "xy")
    c = c.filter(gx * gx + gy * gy <= F.col("bound") * F.col("bound") * _SLACK).select(*by, "p_cx", "p_cy", "c_x", "c_y")
    near = near.withColumns({"p_cx": F.floor(F.col("x") / side), "p_cy": F.floor(F.col("y") / side)})
    dx, dy = F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y")
    met = salted_join(near, c, [*by, "p_cx", "p_cy"], "inner", ident)
    best = met.groupBy(ident).agg(F.min(dx * dx + dy * dy).alias("_d2")).filter(F.col("_d2") <= outer_m * outer_m)
    out = points.join(best, ident, "left")
    return out.withColumn("nearest_presence_km", F.sqrt("_d2") / 1000.0).drop("_d2")


def in_annulus(
    points: DataFrame, centres: DataFrame, by: list[str], ident: str, inner_m: float, outer_m: float, census: DataFrame | None = None
) -> DataFrame:
    """Points with some centre within `outer_m` and none closer than `inner_m`."""
    base = points if census is None else census
    out = grid_join(points, centres, by, outer_m, "left_semi", ident, census=base)
    return outside(out, centres, by, ident, inner_m, base)


def outside(points: DataFrame, centres: DataFrame, by: list[str], ident: str, inner_m: float, census: DataFrame | None = None) -> DataFrame:
    """Points with no centre closer than `inner_m`."""
    if inner_m <= 0:
        return points
    return grid_join(points, centres, by, inner_m, "left_anti", ident, strict=True, census=census)


def not_in_presence_cell(
    points: DataFrame, presences: DataFrame, by: list[str], spread: str, census: DataFrame | None = None, one_a_cell: bool = False
) -> DataFrame:
    """Points whose raster cell holds no presence; with `one_a_cell` no cell holds two points of a group, so none is crowded."""
    keys = [*by, "cell_row", "cell_col"]
    if one_a_cell:
        return points.join(presences.select(*keys).distinct(), keys, "left_anti")
    return salted_join(points, presences.select(*keys).distinct(), keys, "left_anti", spread, census=census)


def _draws(ranked: DataFrame, sizes: DataFrame, by: list[str], factor: float, seed: int) -> DataFrame:
    """ceil(n * factor) numbered draws per group, spread over the ranked rows that cause them."""
    total = F.ceil(F.col("_n") * F.lit(float(factor))).cast("long")
    own = ranked.select(*by, "_rk").join(sizes, by)
    own = own.withColumn("_total", total).filter(F.col("_rk") < F.col("_total"))
    d = own.withColumn("draw", F.explode(F.sequence(F.col("_rk"), F.col("_total") - 1, F.col("_n")))).drop("_rk", "_total")
    return d.withColumn("draw_key", order_key(seed, F.concat_ws(":", *[F.col(b) for b in by], F.col("draw"))))


def _pool_until(
    short: list[DataFrame] | None,
    presences: DataFrame,
    sizes: DataFrame,
    by: list[str],
    grid: Grid,
    seed: int,
    max_rounds: int,
    propose: Callable[[DataFrame, int], DataFrame],
    accept: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Pool candidate rounds, one point per free cell, until every group has as many cells as presences.

    Groups that stay short after `max_rounds` raise, or, where a list is given, go to it as a table
    (`wanted`, `found`) while the others finish.

    Proposals are stored once per round; the acceptance joins count their crowded keys on that table.
    """
    pool, open_groups = None, sizes
    for i in range(max_rounds):
        drawn = materialize(with_cell(propose(open_groups, seed + i), grid), "drawn")
        cand = accept(drawn)
        merged = cand if pool is None else pool.unionByName(cand)
        # A presence closes its whole cell, so one point a cell is chosen first and both steps share a shuffle.
        best = first_by(merged, [*by, "cell_row", "cell_col"], "draw_key")
        pool = materialize(not_in_presence_cell(best, presences, by, "draw_key", one_a_cell=True), "pool")
        have = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("_have"))
        left = sizes.join(have, by, "left").filter(F.coalesce(F.col("_have"), F.lit(0)) < F.col("_n")).drop("_have")
        open_groups = materialize(left, "open_groups")
        if open_groups.isEmpty():
            return pool
    if short is None:
        first = [tuple(r) for r in open_groups.limit(20).collect()]
        raise RuntimeError(f"not enough free background cells after {max_rounds} rounds; short groups (first 20): {first}")
    short.append(same_keys_join(open_groups, have, by, "left").withColumnsRenamed({"_n": "wanted", "_have": "found"}))
    return pool.join(open_groups.select(*by), by, "left_anti")


def _finish(pool: DataFrame, sizes: DataFrame, presences: DataFrame, by: list[str], seed: int, start_m: float, outer_m: float, rule: str) -> DataFrame:
    """Exactly as many background points as presences, with distance, source and rule."""
    picked = pool.withColumn("pick_key", order_key(seed, F.col("draw_key")))
    ranked = exact_rank(picked, by, "pick_key", "_rk")
    kept = materialize(ranked.join(sizes, by).filter(F.col("_rk") < F.col("_n")).drop("_rk", "_n", "pick_key"), "picked")
    out = nearest_presence(kept, as_centres(presences, by), by, "draw_key", start_m, outer_m)
    return out.withColumn("source", F.lit("background")).withColumn("background_sampling_rule", F.lit(rule))


def _km(v: float) -> str:
    return f"{v:g}"


def _prepare(presences: DataFrame, by: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    ranked = materialize(exact_rank(with_albers(presences), by, order, "_rk"), "presences")
    return ranked, materialize(ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "sizes")


def background_radial(
    presences: DataFrame,
    by: list[str],
    order: str,
    grid: Grid,
    outer_km: float,
    inner_km: float = 0.0,
    multiplier: float = 3.0,
    max_rounds: int = 25,
    seed: int = 42,
    short: list[DataFrame] | None = None,
) -> DataFrame:
    """Background around random presences of the same group, area-uniform between two radii.

    `presences` are cell-thinned, with `lat, lon, cell_row, cell_col`.
    """
    if inner_km >= outer_km:
        raise ValueError("the inner radius must be smaller than the outer one")
    ranked, sizes = _prepare(presences, by, order)
    if sizes.isEmpty():
        raise ValueError("no presences to sample around")
    inner, outer = inner_km * 1000.0, outer_km * 1000.0

    def propose(groups: DataFrame, round_seed: int) -> DataFrame:
        d = _draws(ranked, groups, by, multiplier, round_seed)
        pick = F.floor(uniform(F.col("draw_key"), 0) * F.col("_n")).cast("long")
        origin = ranked.select(*by, "_rk", "x", "y")
        near = d.withColumn("_rk", pick).join(origin, [*by, "_rk"])
        ox, oy = annulus_offset(F.col("draw_key"), inner, outer)
        moved = near.select(*by, "draw", "draw_key", (F.col("x") + ox).alias("x"), (F.col("y") + oy).alias("y"))
        lat, lon = albers_inverse(F.col("x"), F.col("y"))
        return moved.withColumn("lat", lat).withColumn("lon", lon)

    def accept(drawn: DataFrame) -> DataFrame:
        # A draw is within the outer radius of its own origin, so only the inner bound can fail.
        return outside(drawn, as_centres(ranked, by), by, "draw_key", inner, drawn)

    pool = _pool_until(short, ranked, sizes, by, grid, seed, max_rounds, propose, accept)
    rule = f"radial_doughnut_{_km(inner_km)}_{_km(outer_km)}_km"
    return _finish(pool, sizes, ranked, by, seed, max(inner * 2, outer / 16), outer, rule)


def background_polygon(
    presences: DataFrame,
    by: list[str],
    order: str,
    grid: Grid,
    outer_km: float,
    inner_km: float = 0.0,
    multiplier: float = 3.0,
    oversample: float = 5.0,
    max_rounds: int = 25,
    seed: int = 42,
    footprint: Callable[[DataFrame], DataFrame] | None = None,
    short: list[DataFrame] | None = None,
) -> DataFrame:
    """Background drawn uniformly in degrees from the zone between two radii around the presences.

    Draws cover the group's bounding box and are rejected outside the zone or the optional footprint.
    """
    if inner_km < 0 or inner_km >= outer_km:
        raise ValueError("radii must satisfy 0 <= inner < outer")
    ranked, sizes = _prepare(presences, by, order)
    if sizes.isEmpty():
        raise ValueError("no presences to sample around")
    inner, outer = inner_km * 1000.0, outer_km * 1000.0
    box = materialize(zone_box(ranked, by, outer), "zone_box")

    def propose(groups: DataFrame, round_seed: int) -> DataFrame:
        d = _draws(ranked, groups, by, multiplier * oversample, round_seed).join(box, by)
        k = F.col("draw_key")
        d = d.withColumn("lon", F.col("x1") + uniform(k, 0) * (F.col("x2") - F.col("x1")))
        d = d.withColumn("lat", F.col("y1") + uniform(k, 1) * (F.col("y2") - F.col("y1")))
        return with_albers(d.select(*by, "draw", "draw_key", "lat", "lon"))

    def accept(drawn: DataFrame) -> DataFrame:
        kept = drawn if footprint is None else footprint(drawn)
        return in_annulus(kept, as_centres(ranked, by), by, "draw_key", inner, outer, drawn)

    pool = _pool_until(short, ranked, sizes, by, grid, seed, max_rounds, propose, accept)
    rule = f"doughnut_{_km(inner_km)}_{_km(outer_km)}_km"
    return _finish(pool, sizes, ranked, by, seed, max(inner * 2, outer / 16), outer, rule)


# Metres per degree of latitude, rounded down, used only to widen a bounding box.
_DEG_M = 110000.0


def zone_box(presences: DataFrame, by: list[str], outer_m: float) -> DataFrame:
    """Bounding box in degrees of all points within `outer_m` of a presence.

    A degree of longitude shrinks with the cosine of the latitude farthest out; two simple lower bounds of the
    cosine keep the box wide enough everywhere.
    """
    py = outer_m / _DEG_M
    m = F.greatest(F.abs(F.max("lat")), F.abs(F.min("lat"))) + py
    px = outer_m / (_DEG_M * F.greatest(1.0 - 0.00015231 * m * m, 1.0 - m / 90.0, F.lit(0.001)))
    return presences.groupBy(*by).agg(
        (F.min("lon") - px).alias("x1"), (F.max("lon") + px).alias("x2"),
        (F.min("lat") - py).alias("y1"), (F.max("lat") + py).alias("y2"),
    )


def random_points(
    seeds: DataFrame, ident: str, per_row: int, box: tuple[float, float, float, float], inside: Callable[[Column, Column], Column], seed: int, n: int,
    max_rounds: int = 8,
) -> DataFrame:
    """Exactly `n` uniform points in a polygon by rejection, or an error.

    Every row of `seeds` makes `per_row` draws, twice as many in each further round, until `inside` accepts `n`;
    the first of them in order of their keys are taken.
    """
    x1, y1, x2, y2 = box
    for i in range(max_rounds):
        d = seeds.select(ident).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit((per_row << i) - 1))))
        d = d.withColumn("draw_key", order_key(seed, F.concat_ws(":", F.col(ident), F.col("draw"))))
        d = d.withColumn("px", F.lit(x1) + uniform(F.col("draw_key"), 0) * (x2 - x1))
        d = d.withColumn("py", F.lit(y1) + uniform(F.col("draw_key"), 1) * (y2 - y1))
        hits = materialize(d.filter(inside(F.col("px"), F.col("py"))), "hits")
        if hits.count() >= n:
            return exact_rank(hits, [], "draw_key", "_rk").filter(F.col("_rk") < n).drop("_rk")
    raise RuntimeError(f"fewer than {n} points fell into the polygon")


def spatial_thin(points: DataFrame, by: list[str], ident: str, key: str, distance_m: float, max_rounds: int = 200) -> DataFrame:
    """Greedy thinning in key order: keep a point, drop everything within `distance_m` of it.

    Computed as the lexicographically first maximal independent set (Blelloch, Fineman, Shun 2012).
    Bins are so small that all points of a bin exclude each other, so each round only the smallest key
    of a bin can be kept: every point meets a bounded number of candidates, and no pair list of a
    crowded bin ever exists. Input needs `x, y`; rounds are written out, the driver only asks whether
    any point is left.
    """
    if distance_m <= 0:
        return points.withColumn("spatial_thin_distance_m", F.lit(0.0))
    side = distance_m / 2**0.5
    left = materialize(points.select(*by, ident, F.col(key).alias("_k"), "x", "y"), "thin_0")
    kept = None
    for i in range(max_rounds):
        bins = left.withColumn("_bx", F.floor(F.col("x") / side)).withColumn("_by", F.floor(F.col("y") / side))
        first = bins.groupBy(*by, "_bx", "_by").agg(F.min(F.struct("_k", ident, "x", "y")).alias("_m"))
        cand = first.select(*by, *[F.col(f"_m.{c}").alias(f"c_{c}") for c in ("x", "y", "_k", ident)])
        cand = materialize(cand, f"thin_candidates_{i}")
        beaten = grid_join(
            left, cand, by, distance_m, "inner", ident, reach=1, extra=F.col("_k") < F.col("c__k")
        ).select(f"c_{ident}").distinct()
        won = materialize(cand.join(beaten, f"c_{ident}", "left_anti"), f"thin_kept_{i}")
        kept = won if kept is None else kept.unionByName(won)
        left = materialize(grid_join(left, won, by, distance_m, "left_anti", ident), f"thin_{i + 1}")
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"thinning did not settle in {max_rounds} rounds")
    ids = kept.select(F.col(f"c_{ident}").alias(ident))
    return points.join(ids, ident, "left_semi").withColumn("spatial_thin_distance_m", F.lit(float(distance_m)))


def neighbours_within(points: DataFrame, centres: DataFrame, by: list[str], ident: str, distance_m: float) -> DataFrame:
    """(centre, point) pairs at most `distance_m` apart; centres are thinned, so pairs grow with the points."""
    return grid_join(points, as_centres(centres, by, [ident]), by, distance_m, "inner", ident)
