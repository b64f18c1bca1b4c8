"""Raster block tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a block's row and column that the order of a table looks at.
BITS = 31


def z_order(row: Column, col: Column) -> Column:
    """Key by which blocks that lie near each other in both directions mostly come together: the two numbers' bits in turn."""
    key = F.lit(0).cast("long")
    for value, place in ((col, 0), (row, 1)):
        # Blocks left of or above the origin have negative numbers.
        v = value.cast("long") + (1 << (BITS - 1))
        for k in range(BITS):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1).cast("long")), 2 * k + place))
    return key


def write_blocks(blocks: DataFrame, path: str, files: int | None = None) -> None:
    """Store blocks in Z-order across files and inside each, so a window read opens few files and skips row groups.

    `files` defaults to the session's number of shuffle partitions.
    """
    d = blocks.withColumn("_z", z_order(F.col("block_row"), F.col("block_col")))
    d = d.repartitionByRange(*([files] if files else []), "_z").sortWithinPartitions("_z").drop("_z")
    d.write.mode("errorifexists").parquet(path)


def read_blocks(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """Blocks of a raster, optionally only those of a window (inclusive block ranges, pushed to the scan)."""
    d = spark.read.parquet(path)
    if rows:
        d = d.filter(d.block_row.between(*rows))
    if cols:
        d = d.filter(d.block_col.between(*cols))
    return d
