"""Occurrence files: CSV with varying headers, one species per file or a species column."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import blank_to_null, species_slug_from_path, title_case, to_number
from ..operators.clean import clean_coords, fill_defaults, uncertainty_filter

# Accepted column names, first hit wins, exact case.
LAT_NAMES = ["decimalLatitude", "latitude", "lat", "Lat", "LAT"]
LON_NAMES = ["decimalLongitude", "longitude", "lon", "Long", "LON"]
UNCERTAINTY_NAMES = [
    "coordinateUncertaintyInMeters", "coordinate_uncertainty_m", "coordinate_uncertainty", "coordinateUncertainty", "uncertainty",
]


def pick_column(header: list[str], asked: str | None, names: list[str], label: str, required: bool) -> int | None:
    """Position of a column: the asked one, else the first known name; missing required columns raise."""
    wanted = [asked] if asked and asked != "auto" else names
    for n in wanted:
        if n in header:
            return header.index(n)
    if required:
        raise ValueError(f"no {label} column; looked for {wanted} in {header}")
    return None


def list_files(spark: SparkSession, path: str, suffix: str = ".csv") -> list[str]:
    """Files below a path; only names are read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    it, out = fs.listFiles(root, True), []
    while it.hasNext():
        f = it.next()
        name = f.getPath().getName()
        if name.endswith(suffix) and not name.startswith(("_", ".")) and f.getLen() > 0:
            out.append(f.getPath().toString())
    return sorted(out)


def headers(spark: SparkSession, files: list[str], sep: str = ",") -> dict[str, list[str]]:
    """Header of each file: one distributed read takes the first line of every first block; quoted names are understood."""
    if not files:
        return {}
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.filter("at = 0").withColumn("n", F.monotonically_increasing_id())
    first = lines.groupBy("f").agg(F.min_by("value", "n").alias("line")).collect()  # one row per file
    return {r["f"]: [c.strip() for c in next(csv.reader([r["line"].lstrip("\ufeff")], delimiter=sep), [""])] for r in first}


def read_occurrences(
    spark: SparkSession,
    path: str,
    lat_col: str | None = None,
    lon_col: str | None = None,
    uncertainty_col: str | None = None,
    source_col: str = "Source",
    species_col: str = "species",
    max_uncertainty_m: float | None = None,
    multi_line: bool = True,
) -> tuple[DataFrame, list[tuple[str, str]], DataFrame]:
    """(clean occurrences, files left out with the reason, rows left out) of a folder or file.

    Files are grouped by header; each group is one scan by column position, all species in one job.
    A file without coordinates is reported and the others continue. Species is a key everywhere, so a
    missing value takes the file's species. Quoted fields may hold doubled quotes and line breaks; where files
    are known to have no line breaks in fields, `multi_line=False` lets large files be split.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for f, h in headers(spark, list_files(spark, path)).items():
        by_header.setdefault(tuple(h), []).append(f)
    parts, failed = [], []
    for header, files in by_header.items():
        names = list(header)
        try:
            lat = pick_column(names, lat_col, LAT_NAMES, "latitude", True)
            lon = pick_column(names, lon_col, LON_NAMES, "longitude", True)
        except ValueError as e:
            failed += [(f, str(e)) for f in files]
            continue
        unc = pick_column(names, uncertainty_col, UNCERTAINTY_NAMES, "uncertainty", False)
        src = pick_column(names, source_col, [], "source", False)
        sp = pick_column(names, species_col, [], "species", False)
        # Names that differ only in case collide in Spark, so columns are read by position.
        schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
        d = spark.read.csv(files, schema=schema, header=True, enforceSchema=True, quote='"', escape='"', multiLine=multi_line)
        file_species = title_case(F.regexp_replace(species_slug_from_path(F.col("_metadata.file_path")), "_", " "))
        text = lambda i: F.lit(None).cast("string") if i is None else F.col(f"c{i}")
        parts.append(
            d.select(
                text(lat).alias("lat"), text(lon).alias("lon"), text(unc).alias("uncertainty_text"), text(src).alias("source_text"),
                (file_species if sp is None else F.coalesce(blank_to_null(text(sp)), file_species)).alias("species"), F.lit(unc is not None).alias("_has_unc"),
                F.col("_metadata.file_path").alias("file_path"),
            )
        )
    if not parts:
        raise RuntimeError(f"no readable occurrence file under {path}: {failed}")
    raw = reduce(DataFrame.unionByName, parts)
    # Files without an uncertainty column pass the uncertainty bound.
    d = uncertainty_filter(raw, "uncertainty_text", None)
    if max_uncertainty_m is not None:
        d = d.filter(~F.col("_has_unc") | (F.col("coordinate_uncertainty_m") <= max_uncertainty_m))
    d = fill_defaults(clean_coords(d), "source_text", "species")
    ok = to_number(F.col("lat")).between(-90, 90) & to_number(F.col("lon")).between(-180, 180)
    rejected = raw.filter(~F.coalesce(ok, F.lit(False))).select("file_path", "species", "lat", "lon")
    return d.select("species", "source", "coordinate_uncertainty_m", "lat", "lon"), failed, rejected
