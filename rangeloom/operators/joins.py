"""Equi-joins that stay even when one key holds a large share of the rows, and grid joins on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 200_000
MAX_HOT_KEYS = 4096


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """All keys with more than `hot_rows` rows and more than 1/4096 of all rows, with the number of salts each needs.

    Fewer than 4096 keys can have such a share, so the table is bounded without leaving a key out.
    """
    n = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    bound = F.greatest(F.lit(hot_rows), F.coalesce(n.agg(F.sum("_n")).scalar(), F.lit(0)) / MAX_HOT_KEYS)
    hot = n.withColumn("_bound", bound).filter(F.col("_n") > F.col("_bound"))
    return hot.select(*on, F.ceil(F.col("_n") / F.col("_bound")).cast("int").alias("_salts"))


def same_keys_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys of which NULL is a value like any other; the left side's key columns stay."""
    names = {k: f"_k_{k}" for k in on}
    r = right.withColumnsRenamed(names)
    test = F.lit(True)
    for k, other in names.items():
        test = test & F.col(k).eqNullSafe(F.col(other))
    return left.join(r, test, how).drop(*names.values())


def salted_join(
    many: DataFrame,
    few: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: str | None = None,
    cond: Column | None = None,
    census: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join `many` to `few` on `on`, where `many` may crowd on some keys and `few` is bounded per key.

    Crowded keys of `many` are cut into salts by the hash of `spread`; only their rows of `few` are
    repeated. The table of crowded keys is bounded, so it is broadcast. Keys are counted on `census`
    when given: a stored frame that `many` was filtered from, so a chain of joins does not run its
    earlier steps twice. `cond` may use both sides' columns (names must differ).
    """
    hot = F.broadcast(hot_keys(many if census is None else census, on, hot_rows))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    pick = F.xxhash64(F.col(spread)) if spread else F.xxhash64(*[F.col(c) for c in many.columns])
    left = many.join(hot, on, "left").withColumn("_salt", F.pmod(pick, salts).cast("int")).drop("_salts")
    right = few.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    keys = [*on, "_salt"]
    if cond is None:
        return left.join(right, keys, how).drop("_salt")
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    test = cond
    for k in keys:
        test = test & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(r, test, how).drop("_salt", *[f"_r_{k}" for k in keys])


def with_bin(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    """Square bin `_bx, _by` of each point."""
    return df.withColumn("_bx", F.floor(F.col(x) / side).cast("long")).withColumn(
        "_by", F.floor(F.col(y) / side).cast("long")
    )


def spread_bins(df: DataFrame, x: str, y: str, side: float, reach: int = 1) -> DataFrame:
    """One copy of each point for every bin within `reach` bins of its own."""
    offs = F.sequence(F.lit(-reach), F.lit(reach))
    b = with_bin(df, x, y, side)
    b = b.withColumn("_ox", F.explode(offs)).withColumn("_bx", F.col("_bx") + F.col("_ox")).drop("_ox")
    return b.withColumn("_oy", F.explode(offs)).withColumn("_by", F.col("_by") + F.col("_oy")).drop("_oy")


def grid_join(
    points: DataFrame,
    centres: DataFrame,
    by: list[str],
    radius: float,
    how: str = "inner",
    spread: str | None = None,
    reach: int = 1,
    extra: Column | None = None,
    strict: bool = False,
    census: DataFrame | None = None,
) -> DataFrame:
    """Points (`x, y`) with centres (`c_x, c_y`) at most `radius` apart (`strict`: less than).

    Centres must have bounded density (cell-thinned or mutually separated), so every point meets a
    bounded number of them; crowded point bins are salted. Only centres are copied to neighbour bins.
    """
    side = radius / reach
    p = with_bin(points, "x", "y", side)
    c = spread_bins(centres, "c_x", "c_y", side, reach)
    dx, dy = F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y")
    d2 = dx * dx + dy * dy
    near = d2 < radius * radius if strict else d2 <= radius * radius
    cond = near if extra is None else near & extra
    seen = None if census is None else with_bin(census, "x", "y", side)
    return salted_join(p, c, [*by, "_bx", "_by"], how, spread, cond, seen).drop("_bx", "_by")
