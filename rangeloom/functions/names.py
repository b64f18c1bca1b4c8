"""Fixed names: predictor order, columns that may never be predictors, model families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Climate layers, base predictors and terrain scalars in contract order.
CLIMATE = [f"wc2.1_30s_bio_{i}" for i in range(1, 20)]
ENVIRONMENT = [*CLIMATE, "ghm"]
BASE_PREDICTORS = [*ENVIRONMENT, "lat_norm", "lon_norm"]
TERRAIN_BANDS = ["elevation", "slope", "northness", "eastness"]
TERRAIN_SCALARS = [
    "elev_mean", "elev_sd", "elev_min", "elev_max",
    "slope_mean", "slope_sd", "slope_min", "slope_max",
    "northness_mean", "eastness_mean",
]
# Design and bookkeeping columns that would leak the label.
NEVER_PREDICTORS = [
    "sample_id", "chip_path", "topo_chip_path", "split", "presence", "lat", "lon", "source", "filename", "url", "cell_id",
    "nearest_presence_km", "background_sampling_rule", "block_x", "block_y", "block_id", "block_id_x", "block_id_y",
    "fold", "cv_round", "topo_valid_frac", "topo_normalized",
]
# Other spellings of the seven model families.
FAMILY_ALIASES = {
    "image_only": ["naip_only", "imagery_only"],
    "tabular_only": ["env_only", "climate_only"],
    "topo_only": ["topography_only"],
    "image_tabular": ["image_climate", "naip_climate", "imagery_climate"],
    "topo_tabular": ["topo_climate", "topography_climate"],
    "image_topo": ["naip_topo", "imagery_topo"],
    "image_topo_tabular": [
        "image_tabular_topo", "image_climate_topo", "image_topo_climate",
        "naip_topo_climate", "naip_climate_topo", "full",
    ],
}
# Class names that stored settings use for the families.
FAMILY_CLASSES = {
    "image_only": ["HostImageryOnlyModel"],
    "tabular_only": ["HostClimateOnlyModel", "HostTabularOnlyModel"],
    "topo_only": ["HostTopoOnlyModel"],
    "image_tabular": ["HostImageryClimateModel", "HostImageTabularModel"],
    "topo_tabular": ["HostTopoClimateModel", "HostTopoTabularModel"],
    "image_topo": ["HostImageTopoModel", "HostImageryTopoModel"],
    "image_topo_tabular": [
        "HostImageClimateTopoModel", "HostImageryClimateTopoModel", "HostImageTopoClimateModel", "HostNAIPTopoClimateModel",
    ],
}
# Terrain mean and standard deviation of the 30 m national grid.
TERRAIN_STATS = {
    "elevation": (726.2603002867634, 726.1498602385226),
    "slope": (4.919028345565722, 7.374072011456101),
    "northness": (-0.02528306975286833, 0.6941432105633398),
    "eastness": (0.02390086174964258, 0.7189956314423461),
}
# Coordinate mean and standard deviation used when scoring without a fitted table.
COORD_STATS = {"lat": (39.34043295, 4.24367101), "lon": (-90.41125129, 15.36062434)}


def canonical_family(name: str) -> str:
    """Canonical family of a spelling or a class name; unknown ones raise."""
    family = _spellings().get(name.strip()) or _spellings().get(name.strip().lower())
    if family is None:
        raise ValueError(f"unknown model family: {name!r}")
    return family


def _spellings() -> dict[str, str]:
    """Spelling or class name to family."""
    return {n: f for f, others in FAMILY_ALIASES.items() for n in (f, *others, *FAMILY_CLASSES[f])}


def family_column(name: Column) -> Column:
    """Canonical family of each spelling or class name; NULL stays, an unknown one raises."""
    table = F.create_map(*[F.lit(x) for pair in _spellings().items() for x in pair])
    key = F.trim(name)
    found = F.coalesce(F.try_element_at(table, key), F.try_element_at(table, F.lower(key)))
    wrong = F.raise_error(F.concat(F.lit("unknown model family: "), name)).cast("string")
    return F.when(name.isNotNull(), F.coalesce(found, wrong))


def family_inputs(name: str) -> set[str]:
    """Inputs a family reads: image, topo, tabular."""
    family = canonical_family(name)
    return set(family.removesuffix("_only").split("_"))
