"""Sources, sinks, models, streams and whole flows (S*, K*, M1-M3, M9, F7, F8, V*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.keys import order_key
from ...functions.names import FAMILY_ALIASES, FAMILY_CLASSES, TERRAIN_BANDS, TERRAIN_STATS, family_column
from ...functions.text import first_known
from ...operators import clean, metrics, models, rasters, sampling, spatial, splits
from ...session import materialize, scratch_path
from ...sinks import tables
from ...sources import catalog as files
from ...sources import datasets, occurrences, stats
from ...streaming import landing
from .. import species
from ..registry import Inputs, query
from .common import CELL_SQL, GRID, SEED, rnd
from .rasters import _ENV_AT, _SCORED, _TOPO, _WIN, ENV_GRID, TOPO_GRID, chip_rows, env_blocks, image_blocks, mosaic, topo_blocks
from .sampling import _BLOCK, SP, folded

_CELL = CELL_SQL.format(a="")


@query(
    "S1_read_occurrences", ["occ_raw"],
    """SELECT species, coalesce(source_raw, 'unknown') AS source, try_cast(uncertainty_text AS DOUBLE) AS coordinate_uncertainty_m, try_cast(lat_text AS DOUBLE) AS lat, try_cast(lon_text AS DOUBLE) AS lon
 FROM occ_raw WHERE try_cast(uncertainty_text AS DOUBLE) <= 1500 AND try_cast(lat_text AS DOUBLE) BETWEEN -90 AND 90 AND try_cast(lon_text AS DOUBLE) BETWEEN -180 AND 180""",
)
def read_occurrences(i: Inputs):
    path = scratch_path(i.spark, "occ_csv")
    i.occ_raw.select(
        "species", F.col("lat_text").alias("decimalLatitude"), F.col("lon_text").alias("decimalLongitude"),
        F.col("source_raw").alias("Source"), F.col("uncertainty_text").alias("coordinateUncertaintyInMeters"),
    ).write.csv(path, header=True)
    return occurrences.read_occurrences(i.spark, path, max_uncertainty_m=1500.0)[0]


@query(
    "S2_read_occurrence_dir", ["occ_raw"],
    """SELECT species, count(*) AS n, count(*) FILTER (source = 'unknown') AS n_unknown FROM (SELECT species, CASE WHEN occ_id % 2 = 0 THEN coalesce(source_raw, 'unknown') ELSE 'unknown' END AS source
 FROM occ_raw WHERE try_cast(lat_text AS DOUBLE) BETWEEN -90 AND 90 AND try_cast(lon_text AS DOUBLE) BETWEEN -180 AND 180) s GROUP BY species""",
)
def read_occurrence_dir(i: Inputs):
    # Two header layouts and one file set without coordinates below one folder.
    path, d = scratch_path(i.spark, "occ_dir"), i.occ_raw
    even, odd = d.filter("occ_id % 2 = 0"), d.filter("occ_id % 2 = 1")
    even.select("species", F.col("lat_text").alias("lat"), F.col("lon_text").alias("Long"), F.col("source_raw").alias("Source")).write.csv(f"{path}/a", header=True)
    odd.select(F.col("lon_text").alias("LON"), F.col("lat_text").alias("LAT"), "species").write.csv(f"{path}/b", header=True)
    d.select("species").write.csv(f"{path}/c", header=True)
    got, failed, _ = occurrences.read_occurrences(i.spark, path)
    assert failed, "the file set without coordinates is reported"
    return got.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "unknown").alias("n_unknown"))


@query("S4_raster_file_catalog", ["occ"], "SELECT lower(concat('M_', user_id, '.TIF')) AS name, max(concat(source, '/M_', user_id, '.TIF')) AS path FROM occ GROUP BY user_id")
def raster_file_catalog(i: Inputs):
    return files.raster_file_catalog(i.occ.select(F.concat("source", F.lit("/M_"), "user_id", F.lit(".TIF")).alias("path")))


@query(
    "C_family_spellings", ["trials"],
    "SELECT trial_seq, model_type AS family FROM trials",
)
def family_spellings(i: Inputs):
    # Every trial's family as one of its other spellings or class names, and back.
    def other(m):
        out = m
        for f, spelled in FAMILY_ALIASES.items():
            many = F.array(*[F.lit(x) for x in (f, f" {f.upper()} ", *spelled, *FAMILY_CLASSES[f])])
            out = F.when(m == f, F.get(many, F.pmod("trial_seq", F.size(many)).cast("int"))).otherwise(out)
        return out

    return i.trials.select("trial_seq", family_column(other(F.col("model_type"))).alias("family"))


@query(
    "C_first_non_empty", ["occ_raw"],
    """SELECT occ_id, coalesce(CASE WHEN trim(lat_text) NOT IN ('', 'NA') THEN lat_text END, source_raw, lon_text) AS first_known FROM occ_raw""",
)
def first_non_empty(i: Inputs):
    return i.occ_raw.select("occ_id", first_known(F.col("lat_text"), F.col("source_raw"), F.col("lon_text")).alias("first_known"))


@query("S5_tile_index_available", ["tile_idx"], "SELECT tile_id, regexp_extract(filename, '[^/]+$') AS filename FROM tile_idx WHERE downloaded")
def tile_index_available(i: Inputs):
    have = i.tile_idx.filter("downloaded").select(F.lower("filename").alias("path"))
    return spatial.downloaded_tiles(i.tile_idx.drop("downloaded"), have).select("tile_id", "filename")


@query("S7_read_dataset", ["occ"], "SELECT occ_id, presence FROM occ WHERE user_id % 4 = 0")
def read_dataset(i: Inputs):
    path = scratch_path(i.spark, "dataset")
    d = i.occ.withColumn("split", F.when(F.col("user_id") % 4 == 0, "test").otherwise("train")).withColumn("design", F.lit("uniform")).withColumn("cv_round", F.lit(0))
    tables.write_table(d, path, "dataset")
    return datasets.read_dataset(i.spark, path, "test").select("occ_id", "presence")


@query("S8_norm_stats", ["env_pixel"], "SELECT concat('v', layer) AS var, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS \"count\" FROM env_pixel GROUP BY layer")
def norm_stats(i: Inputs):
    path = scratch_path(i.spark, "stats_json")
    st = rasters.layer_stats(i.env_pixel).withColumn("var", F.concat(F.lit("v"), "layer"))
    stats.write_stats(st, path, "worldclim_stats")
    back = stats.check_stats(stats.read_stats(i.spark, path), [f"v{k}" for k in range(20)])
    return back.select("var", rnd("mean"), rnd("std"), "count")


@query("S9_trial_log", ["trials"], "SELECT run_id, benchmark_name, mean_val_mcc, search_space_json FROM trials")
def trial_log(i: Inputs):
    path = scratch_path(i.spark, "trials_tsv")
    cols = ["run_id", "benchmark_name", "mean_val_mcc", "search_space_json"]
    i.trials.select(*cols).write.csv(path, sep="\t", header=True, quote='"', escape='"')
    return datasets.read_trials(i.spark, path, "run_id string, benchmark_name string, mean_val_mcc double, search_space_json string")


@query("K1_write_points", ["occ"], "SELECT occ_id, presence, species FROM occ")
def write_points(i: Inputs):
    path = scratch_path(i.spark, "points")
    tables.write_table(i.occ, path, "points")
    return tables.read_partition(i.spark, path).select("occ_id", "presence", "species")


@query("K2_write_folds", ["occ"], _BLOCK + "SELECT species, CAST(cv_round AS INTEGER) AS cv_round, count(*) FILTER (fold = cv_round) AS n_test, count(*) AS n FROM k JOIN f USING (species, block_id), (SELECT unnest([1, 2, 3, 4, 5]) AS cv_round) r GROUP BY 1, 2")
def write_folds(i: Inputs):
    path = scratch_path(i.spark, "folds")
    tables.write_table(splits.cv_rounds(folded(i), SP, "order_key", 5), path, "folds")
    d = tables.read_partition(i.spark, path)
    return d.groupBy("species", F.col("cv_round").cast("int").alias("cv_round")).agg(F.count_if(F.col("split") == "test").alias("n_test"), F.count(F.lit(1)).alias("n"))


@query("K3_write_dataset", ["occ"], "SELECT species, split, count(*) AS n FROM (SELECT species, CASE WHEN user_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM occ) s GROUP BY 1, 2")
def write_dataset(i: Inputs):
    path = scratch_path(i.spark, "dataset")
    d = i.occ.withColumn("split", F.when(F.col("user_id") % 4 == 0, "test").otherwise("train")).withColumn("design", F.lit("uniform")).withColumn("cv_round", F.lit(0))
    tables.write_table(d, path, "dataset")
    return i.spark.read.parquet(path).groupBy("species", "split").agg(F.count(F.lit(1)).alias("n"))


@query("K5_append_trial", ["trials"], "SELECT concat(substr(run_id, 1, 15), '_', substr(sha1(search_space_json), 1, 10)) AS run_id, count(*) AS n, CAST(sum(CASE WHEN mean_val_mcc IS NULL THEN 0 ELSE 2 END) AS BIGINT) AS n_folds FROM trials GROUP BY 1")
def append_trial(i: Inputs):
    path = scratch_path(i.spark, "log")
    d = i.trials.withColumn("run_id", tables.trial_key(F.col("search_space_json"), F.substring("run_id", 1, 15)))
    folds = d.filter("mean_val_mcc IS NOT NULL").select("run_id", "trial_seq", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("fold"), F.col("mean_val_mcc").alias("val_mcc"))
    for part in ("bench0", "bench1"):
        keep = F.col("benchmark_name") == part
        tables.append_trial(d.filter(keep), folds.join(d.filter(keep).select("trial_seq"), "trial_seq", "left_semi").withColumn("run_key", F.col("run_id")).drop("run_id").withColumnRenamed("run_key", "run_id"), path)
    r = i.spark.read.parquet(f"{path}/results").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    f = i.spark.read.parquet(f"{path}/fold_metrics").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_folds"))
    return r.join(f, "run_id", "left").withColumn("n_folds", F.coalesce("n_folds", F.lit(0)).cast("long"))


@query(
    "K6_write_mosaic", ["tile_dims"],
    f"WITH {_SCORED.replace('{t}', 'tile_dims')} SELECT tile_id, count(*) AS n, round(avg(prediction), 6) AS prediction FROM mos GROUP BY tile_id",
)
def write_mosaic(i: Inputs):
    path = scratch_path(i.spark, "mosaic")
    tables.write_mosaic(mosaic(i.tile_dims), path)
    return i.spark.read.parquet(path).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("prediction"), 6, "prediction"))


@query("K8_skip_finished", ["tile_dims"], "SELECT tile_id FROM tile_dims WHERE height < 256 OR width < 256")
def skip_finished(i: Inputs):
    return tables.skip_finished(i.tile_dims, mosaic(i.tile_dims)).select("tile_id")


@query("K9_write_eval", ["pred_class"], "SELECT eval_set, count(*) AS n, count(*) FILTER (true_label = predicted_label) AS n_right, CAST(1 AS BIGINT) AS n_summary, CAST(5 AS BIGINT) AS n_report, count(DISTINCT probability) + 1 AS n_pr, true AS has_roc FROM pred_class GROUP BY eval_set")
def write_eval(i: Inputs):
    path = scratch_path(i.spark, "eval")
    tables.write_evaluation(i.pred_class, ["eval_set"], path)
    eval_set = F.col("eval_set").cast("long").alias("eval_set")
    d = tables.read_partition(i.spark, f"{path}/predictions")
    out = d.groupBy(eval_set).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("true_label") == F.col("predicted_label")).alias("n_right"))
    for name in ("summary", "class_report", "pr_curve", "roc_curve"):
        out = out.join(tables.read_partition(i.spark, f"{path}/{name}").groupBy(eval_set).agg(F.count(F.lit(1)).alias(name)), "eval_set")
    return out.select("eval_set", "n", "n_right", F.col("summary").alias("n_summary"), F.col("class_report").alias("n_report"), F.col("pr_curve").alias("n_pr"), (F.col("roc_curve") > 1).alias("has_roc"))


@query(
    "K11_training_batches", ["occ"],
    "SELECT occ_id, CAST(floor((row_number() OVER (PARTITION BY species ORDER BY md5(concat('43:', occ_id))) - 1) / 64) AS BIGINT) AS batch FROM occ",
)
def training_batches(i: Inputs):
    return tables.training_batches(i.occ, SP, "occ_id", SEED, 1, 64).select("occ_id", "batch")


def _model_rows(i: Inputs):
    # Five rows a point are stored, so only with what the models read.
    d = splits.cv_rounds(folded(i), SP, "order_key", 5).select("occ_id", "cv_round", "split", "presence", "lat", "lon", "coordinate_uncertainty_m")
    return materialize(splits.norm_latlon(d, ["cv_round"]).fillna(0.0, ["coordinate_uncertainty_m"]), "model_rows")


@query("M1_fit_tabular", ["occ"])
def fit_tabular(i: Inputs):
    p = models.fit_rounds(_model_rows(i), ["lat_norm", "lon_norm", "coordinate_uncertainty_m"], [1, 2, 3, 4, 5], ["occ_id", "cv_round", "presence"])
    return metrics.summary(p.withColumnRenamed("presence", "true_label"), ["cv_round"]).select("cv_round", "n_samples", "n_positive", rnd("brier", 3))


_MLP = {"widths": (32, 32, 64), "seed": 5}


@query("M2_score_mlp", ["embeddings"])
def score_mlp(i: Inputs):
    w = models.mlp_weights(64, **_MLP)
    return models.score_mlp(i.embeddings, "vec_id", "embedding", w).select("vec_id", rnd("logit", 4))


@query("M3_score_mc_dropout", ["embeddings"])
def score_mc_dropout(i: Inputs):
    w = models.mlp_weights(64, **_MLP)
    d = models.score_mlp(i.embeddings, "vec_id", "embedding", w, passes=4, rate=0.25, seed=SEED)
    from ...operators.tiles import mc_aggregate

    return mc_aggregate(d.withColumn("probability", metrics.sigmoid(F.col("logit"))), ["vec_id"]).select("vec_id", rnd("mean_p", 4), rnd("std_p", 4))


@query("M9_model_families", ["embeddings"])
def model_families(i: Inputs):
    d = chip_rows(i).join(i.embeddings.select("vec_id", F.col("label").alias("presence"), "embedding"), "vec_id")
    img = F.aggregate("px", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / 64
    scalars = [c for c in rasters.summarize_topo(d, "px", 16).columns if c not in d.columns and c != "topo_valid_frac"]
    d = rasters.summarize_topo(d.withColumn("image_mean", img), "px", 16).fillna(0.0)
    values = [F.col("embedding")[k].cast("double").alias(f"env{k}") for k in range(64)]
    # Labels are classes of many kinds; their parity is the binary target.
    d = materialize(d.select("vec_id", (F.col("presence") % 2).cast("int").alias("presence"), "image_mean", *scalars, *values), "family_rows")
    inputs = {"image": ["image_mean"], "topo": scalars, "tabular": [f"env{k}" for k in range(64)]}
    d = splits.stratified_split(d.withColumn("key", order_key(SEED, F.col("vec_id"))), [], "key", 0.8, 0.0)
    train, test = d.filter("split = 'train'"), d.filter("split = 'test'")
    p = models.compare_families(train, test, inputs, ["vec_id", "presence"]).withColumnRenamed("presence", "true_label")
    return metrics.summary(p, ["model_type"]).select("model_type", "n_samples", rnd("brier", 3))


#: Windows of 8 x 8 pixels cut from image blocks of 4 x 4, terrain chips of 4 x 4 from blocks of 4 x 4.
CHIPS = species.ChipPlan(8, 4, 4, 16.0, TOPO_GRID, 4, 4)


def _points(i: Inputs):
    """Occurrences at the image sites of their users; a user without a site has none and gets no chip."""
    at = i.occ.join(i.site.withColumnRenamed("sample_id", "user_id"), "user_id", "left").withColumn("site_id", F.col("user_id"))
    return at.withColumnsRenamed({"x": "site_x", "y": "site_y"}).withColumn("point_id", F.col("occ_id").cast("string")).withColumnRenamed("order_key", "point_key")


def _sites(points):
    return points.filter("site_x IS NOT NULL").select("site_id", F.col("site_x").alias("x"), F.col("site_y").alias("y"))


def _env_stats(i: Inputs):
    return rasters.layer_stats(i.env_pixel.filter("layer < 19"))


_ELEV = TERRAIN_STATS[TERRAIN_BANDS[0]]


@query(
    "F7_build_dataset", ["occ", "env_pixel", "img_tile", "img_pixel", "site", "topo_pixel"],
    _BLOCK + ", " + (_WIN + _TOPO).removeprefix("WITH ") + f""", {_ENV_AT},
 hx AS (SELECT sample_id, band, r - ro AS y, c - co AS x, first(v ORDER BY tile_id) FILTER (v <> 0) AS v FROM pair JOIN img_pixel USING (tile_id) WHERE r >= ro AND r < ro + 8 AND c >= co AND c < co + 8 GROUP BY 1, 2, 3, 4),
 chip AS (SELECT sample_id, coalesce(sum(v), 0) AS chip_sum FROM hx GROUP BY sample_id),
 tm AS (SELECT sample_id, i, band, sum(w * q.v) / sum(w) FILTER (q.v IS NOT NULL) AS v FROM wt JOIN topo_pixel q ON q.r = wt.r AND q.c = wt.c WHERE w > 0 GROUP BY 1, 2, 3),
 tok AS (SELECT sample_id, i, max(v) FILTER (band = 0) AS elev FROM tm GROUP BY 1, 2 HAVING count(v) = 4),
 tv AS (SELECT sample_id, avg((elev - ({_ELEV[0]!r})) / {_ELEV[1]!r}) AS elev_mean FROM tok GROUP BY sample_id HAVING count(*) >= 8),
 ready AS (SELECT occ_id FROM e GROUP BY occ_id HAVING count(v) = 20),
 u AS (SELECT occ_id, user_id, species, presence, 'uniform' AS design, 0 AS cv_round, CASE WHEN rk < round_even(n * 0.7, 0) THEN 'train' WHEN rk < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split
   FROM (SELECT *, row_number() OVER (PARTITION BY species, presence ORDER BY order_key) - 1 AS rk, CAST(count(*) OVER (PARTITION BY species, presence) AS DOUBLE) AS n FROM occ) a),
 r AS (SELECT k.*, fold, unnest(range(1, 6)) AS cv_round FROM k JOIN f USING (species, block_id)),
 n AS (SELECT *, row_number() OVER w - 1 AS rk, CAST(count(*) OVER (PARTITION BY species, cv_round, presence, fold = cv_round) AS DOUBLE) AS n FROM r WINDOW w AS (PARTITION BY species, cv_round, presence, fold = cv_round ORDER BY order_key)),
 cv AS (SELECT occ_id, user_id, species, presence, 'spatial_cv' AS design, cv_round, CASE WHEN fold = cv_round THEN 'test' WHEN rk < round_even(n * 0.7, 0) THEN 'train' ELSE 'val' END AS split FROM n),
 al AS (SELECT * FROM u UNION ALL SELECT * FROM cv)
 SELECT species, design, CAST(cv_round AS INTEGER) AS cv_round, split, count(*) AS n, CAST(sum(presence) AS BIGINT) AS n_presence, CAST(sum(chip_sum) AS BIGINT) AS chip_sum, round(avg(elev_mean), 4) AS elev_mean
 FROM al JOIN ready USING (occ_id) JOIN chip ON chip.sample_id = user_id JOIN tv ON tv.sample_id = user_id GROUP BY 1, 2, 3, 4""",
)
def build_dataset(i: Inputs):
    pts = materialize(sampling.with_albers(_points(i)), "points")
    chips, topo = species.extract_chips(_sites(pts), i.img_tile, image_blocks(i), topo_blocks(i), CHIPS)
    # The points' other names and their sites' places say what point_id and site_id do.
    rows = species.designs(pts.drop("occ_id", "user_id", "site_x", "site_y"), 0.70, 0.15, 200000.0, 5)
    d = species.build_dataset(pts, rows, chips, topo, env_blocks(i), ENV_GRID, 16, _env_stats(i), 0.5)
    light = materialize(chips.select("site_id", F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v).alias("chip_sum")), "chip_sums")
    d = d.join(light, "site_id").groupBy("species", "design", "cv_round", "split")
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("presence").alias("n_presence"), F.sum("chip_sum").alias("chip_sum"), rnd(F.avg("elev_mean"), 4, "elev_mean"))


@query("F8_species_flow", ["occ", "tile_idx", "img_tile", "img_pixel", "topo_pixel", "env_pixel"])
def species_flow(i: Inputs):
    """From occurrences to the written dataset of every species; sites lie on the image strip in proportion to the coordinates."""
    pts = species.presence_background(i.occ, i.tile_idx, GRID, 50.0, 5.0, 800.0)
    x, y = F.floor((F.col("lon") + 121) * 6) + 0.5, -F.floor((F.col("lat") - 29) * 1.2) - 0.5
    pts = pts.withColumn("site_id", F.xxhash64(x, y)).withColumn("site_x", x).withColumn("site_y", y)
    path = scratch_path(i.spark, "species")
    rows = species.designs(pts, 0.70, 0.15, 200000.0, 5)
    sites = pts.select("point_id", "lat", "lon", "site_id", F.col("site_x").alias("x"), F.col("site_y").alias("y"))
    species.write_species(sites, rows, i.img_tile, image_blocks(i), topo_blocks(i), CHIPS, env_blocks(i), ENV_GRID, 16, _env_stats(i), path, 0.5)
    d = tables.read_partition(i.spark, f"{path}/dataset")
    cut = i.spark.read.parquet(f"{path}/images").join(i.spark.read.parquet(f"{path}/topo_chips").select("site_id"), "site_id").select("site_id")
    d = clean.chip_exists(d, cut, ["site_id"])
    return d.groupBy("species", "design", F.col("cv_round").cast("int").alias("cv_round"), "split", "presence").agg(F.count(F.lit(1)).alias("n"))


@query("V1_stream_occurrences", ["occ"], f"SELECT species, cell_row, cell_col, occ_id FROM (SELECT *, {_CELL} FROM occ) c QUALIFY row_number() OVER (PARTITION BY species, cell_row, cell_col ORDER BY order_key) = 1")
def stream_occurrences(i: Inputs):
    land, out, check = (scratch_path(i.spark, k) for k in ("landing", "state", "checkpoint"))
    i.occ.select("occ_id", "species", "lat", "lon", F.col("coordinate_uncertainty_m").alias("uncertainty")).repartition(4, "occ_id").write.parquet(land)
    schema = "occ_id long, species string, lat double, lon double, uncertainty double"
    d = landing.stream_occurrences(i.spark, land, schema, out, check, GRID, SEED, files_per_batch=2)
    return d.select("species", "cell_row", "cell_col", "occ_id")


@query(
    "V2_stream_trials", ["trials"],
    """SELECT benchmark_name, run_id, mean_val_mcc, mean_val_auc FROM trials WHERE mean_val_mcc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY benchmark_name
 ORDER BY mean_val_mcc DESC, mean_val_auc DESC, mean_val_sensitivity DESC, mean_val_specificity DESC, mean_val_loss, run_id DESC) = 1""",
)
def stream_trials(i: Inputs):
    land, out, check = (scratch_path(i.spark, k) for k in ("landing", "state", "checkpoint"))
    cols = ["benchmark_name", "run_id", "mean_val_mcc", "mean_val_auc", "mean_val_sensitivity", "mean_val_specificity", "mean_val_loss"]
    i.trials.select(*cols).repartition(3, "run_id").write.parquet(land)
    schema = "benchmark_name string, run_id string, " + ", ".join(f"{c} double" for c in cols[2:])
    return landing.stream_trials(i.spark, land, schema, out, check, files_per_batch=1)


@query(
    "flagship_block_folds", ["occ"],
    f"""WITH ok AS (SELECT * FROM occ WHERE coordinate_uncertainty_m <= 1800), cc AS (SELECT *, {_CELL} FROM ok),
 th AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY species, cell_row, cell_col ORDER BY order_key) = 1), """
    + _BLOCK.removeprefix("WITH ").replace("FROM occ)", "FROM th)", 1)
    + "SELECT species, fold, count(*) AS n, CAST(sum(presence) AS BIGINT) AS n_presence FROM k JOIN f USING (species, block_id) GROUP BY 1, 2",
)
def flagship(i: Inputs):
    d = clean.uncertainty_filter(clean.clean_coords(i.occ), "coordinate_uncertainty_m", 1800.0)
    d = sampling.thin_to_cell(d, GRID, SP, "order_key")
    d = splits.assign_folds(splits.spatial_blocks(sampling.with_albers(d), SP, 200000.0), SP, 5, SEED)
    return d.groupBy("species", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("presence").alias("n_presence"))
