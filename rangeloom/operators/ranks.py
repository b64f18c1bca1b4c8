"""Global ranks and running sums that never need a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .joins import same_keys_join

#: Rows that a bucket of a rank should have at most.
BUCKET_ROWS = 65_536


def _key_buckets(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """`_kb`: as many leading digits of the md5 column `key` as the size of the row's group asks for.

    Only groups of over 16 * BUCKET_ROWS rows ask for more than one; there are few of those, so they are broadcast.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    digits = F.greatest(F.lit(1), F.ceil(F.log(F.col("_size") / float(BUCKET_ROWS)) / F.log(F.lit(16.0)))).cast("int")
    if by:
        crowded = sizes.filter(F.col("_size") > 16 * BUCKET_ROWS).select(*by, digits.alias("_digits"))
        d = same_keys_join(df, F.broadcast(crowded), by, "left").withColumn("_digits", F.coalesce("_digits", F.lit(1)))
    else:
        d = df.withColumn("_digits", sizes.select(digits).scalar())
    return d.withColumn("_kb", F.substr(F.col(key), F.lit(1), F.col("_digits"))).drop("_digits")


def _bucket_starts(d: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """The rows `d` and one more (`_start`) for each of their buckets, with each sum over the earlier buckets of its group
    (under the sum's name) and over the whole group (`<name>_total`). So rows meet their bucket's numbers in the window's own shuffle."""
    counts = d.groupBy(*by, "_kb").agg(*[c.alias(m) for m, c in sums.items()])
    # Bucket rows reach these windows, not rows.
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = group.orderBy("_kb").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        *by, "_kb", F.lit(True).alias("_start"),
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(m) for m in sums], *[F.sum(m).over(group).alias(f"{m}_total") for m in sums],
    )
    return d.unionByName(starts, allowMissingColumns=True)


def exact_rank(
    df: DataFrame, by: list[str], key: str, out: str = "rank", total: str | None = None
) -> DataFrame:
    """0-based rank by the md5 column `key` inside each `by` group; `total` names a group size column.

    The leading hex digits split every group into even buckets, as many digits as its size asks for, so a
    group that holds most of the rows still spreads over all tasks; only bucket counts are summed in order.
    A NULL group is a group of its own. Rows are shuffled once.
    """
    d = _bucket_starts(_key_buckets(df, by, key), by, {"_off": F.count(F.lit(1))})
    inside = W.partitionBy(*by, "_kb").orderBy(F.col("_start").isNull(), key)
    d = d.withColumn(out, (F.row_number().over(inside) - 2 + F.first("_off").over(inside)).cast("long"))
    if total:
        d = d.withColumn(total, F.first("_off_total").over(inside))
    return d.filter("_start IS NULL").drop("_kb", "_start", "_off", "_off_total")


def earlier_counts(df: DataFrame, by: list[str], key: str, marks: dict[str, Column]) -> DataFrame:
    """For each mark, the group's rows with it that come earlier by the md5 column `key` (`<name>_before`) and all (`<name>_total`).

    Buckets are those of `exact_rank`; all marks share one shuffle.
    """
    d = _key_buckets(df.withColumns({m: F.coalesce(c, F.lit(False)).cast("long") for m, c in marks.items()}), by, key)
    d = _bucket_starts(d, by, {m: F.sum(m) for m in marks})
    inside = W.partitionBy(*by, "_kb").orderBy(F.col("_start").isNull(), key)
    before, first = inside.rowsBetween(W.unboundedPreceding, -1), inside.rowsBetween(W.unboundedPreceding, 0)
    # A bucket's first row holds what earlier buckets have.
    d = d.withColumns({f"{m}_before": F.sum(m).over(before) for m in marks} | {f"{m}_total": F.first(f"{m}_total").over(first) for m in marks})
    return d.filter("_start IS NULL").drop("_kb", "_start", *marks)


def sorted_rank(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """1-based position of every row in its group by `order`, from one sort over ranges of (`by`, `order`).

    Ranges follow all keys, so a group that holds most of the rows, or most of one leading value, spreads over as
    many tasks as its other keys allow; only a row for each range and group is summed in order.
    """
    keys = [*[F.col(b).asc_nulls_first() for b in by], *order]
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    # The upper bits of the id are the range, the lower ones count its rows; stored, so they stay what they are.
    d = materialize(d, "sorted").withColumn("_range", F.shiftright("_id", 33))
    sizes = d.groupBy(*by, "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = same_keys_join(d, offsets, [*by, "_range"])
    return placed.withColumn(out, F.col("_id") - F.col("_first") + F.col("_before") + 1).drop("_id", "_range", "_first", "_before")


def value_buckets(v: Column) -> tuple[Column, Column]:
    """Two-level bucket of a double, non-decreasing in `v`: 64 parts per power of two, 4096 parts of each.

    Every doubling of the magnitude has its own buckets, so crowds near zero or near one still separate.
    """
    t = F.log2(F.abs(v)) * 64.0
    up, side = F.floor(t), F.signum(v)
    coarse = F.when(v == 0, F.lit(0)).otherwise(side * (up + 1_000_000)).cast("long")
    fine = F.when(v == 0, F.lit(0)).otherwise(side * F.floor((t - up) * 4096.0)).cast("long")
    return coarse, fine


def before(
    df: DataFrame,
    by: list[str],
    coarse: Column,
    fine: Column,
    order: list[Column],
    sums: list[str] | None = None,
    maxes: list[str] | None = None,
    suffix: str = "_before",
    totals: bool = False,
) -> DataFrame:
    """Sums and maxima of columns over the rows of the group that come strictly earlier in `order`.

    (`coarse`, `fine`) are ordered like `order`, rows of one bucket being adjacent. Bucket totals are
    carried forward first, so a group that holds most rows is spread over its buckets. `totals` adds
    each column's value over the whole group as `<column>_total`.
    """
    fns = {v: F.sum for v in sums or []} | {v: F.max for v in maxes or []}
    d = df.withColumn("_c", coarse).withColumn("_f", fine)
    small = d.groupBy(*by, "_c", "_f").agg(*[fn(v).alias(v) for v, fn in fns.items()])
    large = small.groupBy(*by, "_c").agg(*[fn(v).alias(v) for v, fn in fns.items()])

    def prior(part: list, cols: list) -> W:
        return W.partitionBy(*part).orderBy(*cols).rowsBetween(W.unboundedPreceding, -1)

    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    whole = [fn(v).over(group).alias(f"{v}_total") for v, fn in fns.items()] if totals else []
    large = large.select(*by, "_c", *whole, *[fn(v).over(prior(by or [F.lit(0)], ["_c"])).alias(f"_c_{v}") for v, fn in fns.items()])
    small = small.select(*by, "_c", "_f", *[fn(v).over(prior([*by, "_c"], ["_f"])).alias(f"_f_{v}") for v, fn in fns.items()])
    out = same_keys_join(d, same_keys_join(small, large, [*by, "_c"]), [*by, "_c", "_f"])
    inside = prior([*by, "_c", "_f"], order)
    for v, fn in fns.items():
        parts = [fn(v).over(inside), F.col(f"_c_{v}"), F.col(f"_f_{v}")]
        if fn is F.sum:
            total = sum((F.coalesce(x, F.lit(0)) for x in parts[1:]), F.coalesce(parts[0], F.lit(0)))
        else:
            total = F.greatest(*parts)
        out = out.withColumn(v + suffix, total)
    return out.drop("_c", "_f", *[f"_c_{v}" for v in fns], *[f"_f_{v}" for v in fns])


def prefix_sum(df: DataFrame, by: list[str], key: str, vals: list[str], suffix: str = "_above") -> DataFrame:
    """For each row, sums of `vals` over rows of the group with a strictly greater number `key`, and over the group."""
    c, f = value_buckets(F.col(key))
    return before(df, by, -c, -f, [F.desc(key)], sums=vals, suffix=suffix, totals=True)


def quantiles(df: DataFrame, by: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group without holding a group in one task.

    Equal values are counted first; running counts then place each quantile between two values.
    """
    g = df.filter(F.col(col).isNotNull() & ~F.isnan(col)).groupBy(*by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    c, f = value_buckets(F.col("_v"))
    placed = before(g, by, c, f, [F.col("_v")], sums=["_n"], totals=True)
    aggs = []
    for name, p in probs.items():
        h = (F.col("_n_total") - 1) * F.lit(p)
        low, high = F.floor(h), F.ceil(h)

        def at(pos: Column) -> Column:
            hit = (F.col("_n_before") <= pos) & (pos < F.col("_n_before") + F.col("_n"))
            return F.max(F.when(hit, F.col("_v")))

        aggs.append((at(low) + (at(high) - at(low)) * F.max(h - low)).alias(name))
    return placed.groupBy(*by).agg(*aggs)
