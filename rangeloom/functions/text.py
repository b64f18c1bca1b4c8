"""Text, number-parsing and formatting expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings read as missing in occurrence tables.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
# Spellings of true in flag columns.
TRUE_TOKENS = ["true", "1", "yes", "y", "t"]
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def blank_to_null(c: Column) -> Column:
    """Missing spellings become NULL."""
    return F.when(F.trim(c).isin(MISSING_TOKENS), None).otherwise(c)


def first_known(*texts: Column) -> Column:
    """The first text that is no missing spelling; NULL if all are."""
    return F.coalesce(*[blank_to_null(c) for c in texts])


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain number is NULL."""
    t = F.trim(c)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def to_bool(c: Column) -> Column:
    """Flag text to boolean; missing is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(TRUE_TOKENS), F.lit(False))


def slug(c: Column) -> Column:
    """File-safe name: lower case, runs of other characters become one underscore."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def species_slug_from_path(path: Column) -> Column:
    """Species slug from an occurrence file name, without its thinning suffix."""
    return slug(F.regexp_replace(file_stem(path), "(?i)_thin.*$", ""))


def _cap(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def display_name(s: Column) -> Column:
    """Slug to a label: every non-empty part capitalised, underscores kept."""
    parts = F.filter(F.split(s, "_"), lambda x: x != "")
    return F.array_join(F.transform(parts, _cap), "_")


def title_case(c: Column) -> Column:
    """Capital after every non-letter (so `2b` becomes `2B`), unlike `initcap`."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, _cap), "")


def base_name(path: Column) -> Column:
    """Last path part; both slash kinds separate."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def _g(v: float, digits: int) -> str:
    return "nan" if math.isnan(v) else f"{v:.{digits}g}"


def general_number(x: Column, digits: int = 6) -> Column:
    """Shortest `%g` text with at most `digits` significant digits.

    The JVM's `%g` keeps trailing zeros and rounds ties of the decimal form, so this is an
    Arrow-batched function.
    """

    @F.pandas_udf(T.StringType())
    def fmt(s: pd.Series) -> pd.Series:
        return s.map(lambda v: _g(v, digits), na_action=None)

    return fmt(x)


def _setting(v: str | None) -> str:
    if v is None:
        return "None"
    try:
        x = float(v)
    except ValueError:
        return v.capitalize() if v in ("true", "false") else v
    return _g(x, 2 if x and (abs(x) < 0.001 or abs(x) >= 10000) else 6)


@F.pandas_udf(T.ArrayType(T.StringType()))
def setting_texts(s: pd.Series) -> pd.Series:
    """Display texts of settings: numbers shortened (very small and large ones to two digits), words unchanged."""
    return s.map(lambda vs: [_setting(v) for v in vs])


def settings_equal(a: Column, b: Column) -> Column:
    """Numbers (and booleans as 1 and 0) equal within 1e-12 relative or absolute; otherwise equal text."""
    x, y = (F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(to_number(v)) for v in (a, b))
    near = F.abs(x - y) <= F.greatest(F.lit(1e-12), F.greatest(F.abs(x), F.abs(y)) * 1e-12)
    return F.coalesce(near, a.eqNullSafe(b))
