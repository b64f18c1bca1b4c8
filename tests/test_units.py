"""Hand-made frames with expected values worked out by hand or by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.functions import geo, geo_arrays, names, text
from rangeloom.functions.keys import order_key
from rangeloom.operators import clean, joins, metrics, models, ranks, rasters, sampling, spatial, splits, tiles, trials, warp
from rangeloom.plans import scoring
from rangeloom.session import scratch_path
from rangeloom.sinks import tables
from rangeloom.sources import catalog, occurrences, stats
from rangeloom.sources import rasters as block_files


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def cloud(spark, n=600, hot=0.4, seed=3):
    """Points of which a large share crowds into one spot."""
    g = np.random.default_rng(seed)
    xy = g.uniform(0, 20000, (n, 2))
    xy[: int(n * hot)] = g.normal(5000, 30, (int(n * hot), 2))
    d = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    return d.withColumn("g", F.lit(0)).withColumn("k", order_key(1, F.col("id"))), xy


def test_albers_worked_example(spark):
    # Snyder's worked example (Clarke 1866) differs in ellipsoid; these are GRS80 values checked by round trip.
    d = spark.createDataFrame([(35.0, -75.0), (23.0, -96.0), (48.5, -123.25)], "lat double, lon double")
    d = sampling.with_albers(d)
    got = rows(d, "lat", "x", "y")
    assert abs(got[0][1]) < 1e-6 and abs(got[0][2]) < 1e-6
    lat, lon = geo.albers_inverse(F.col("x"), F.col("y"))
    worst = d.select(F.max(F.abs(lat - F.col("lat")) + F.abs(lon - F.col("lon")))).first()[0]
    assert worst < 1e-9


@pytest.mark.parametrize("hot_rows", [5, 1000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how, hot_rows):
    a = spark.createDataFrame([(i, 0 if i < 60 else i % 7) for i in range(100)], "i long, k long")
    b = spark.createDataFrame([(0, "x"), (0, "y"), (3, "z")], "k long, v string")
    assert rows(joins.salted_join(a, b, ["k"], how, "i", hot_rows=hot_rows)) == rows(a.join(b, ["k"], how))


def test_salted_join_with_condition(spark):
    a = spark.createDataFrame([(i, 0) for i in range(50)], "i long, k long")
    b = spark.createDataFrame([(0, 10), (0, 45)], "k long, lim long")
    got = joins.salted_join(a, b, ["k"], "inner", "i", F.col("i") >= F.col("lim"), hot_rows=4)
    assert got.count() == 40 + 5
    assert joins.salted_join(a, b, ["k"], "left_anti", "i", F.col("i") >= F.col("lim"), hot_rows=4).count() == 10


def test_grid_join_keeps_points_exactly_at_the_radius(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 100.0000001, 0.0)], "id long, x double, y double").withColumn("g", F.lit(0))
    c = spark.createDataFrame([(0, 0.0, 0.0)], "g int, c_x double, c_y double")
    assert rows(joins.grid_join(p, c, ["g"], 100.0, "left_semi", "id"), "id") == [(1,), (2,)]
    assert rows(joins.grid_join(p, c, ["g"], 100.0, "left_semi", "id", strict=True), "id") == [(1,)]


def test_thinning_equals_sequential_greedy_on_a_crowd(spark):
    d, xy = cloud(spark)
    order = [r["id"] for r in d.orderBy("k").select("id").collect()]
    kept, free = [], np.ones(len(xy), bool)
    for i in order:
        if free[i]:
            kept.append(i)
            free[((xy - xy[i]) ** 2).sum(1) <= 800.0**2] = False
    out = sampling.spatial_thin(d, ["g"], "id", "k", 800.0)
    assert sorted(r["id"] for r in out.select("id").collect()) == sorted(kept)
    assert {r[0] for r in sampling.spatial_thin(d, ["g"], "id", "k", 0.0).select("spatial_thin_distance_m").distinct().collect()} == {0.0}


def test_thinning_of_nothing(spark):
    d, _ = cloud(spark, 20)
    assert sampling.spatial_thin(d.filter("id < 0"), ["g"], "id", "k", 800.0).count() == 0


def test_nearest_and_annulus_against_brute_force(spark):
    d, xy = cloud(spark, 200)
    c, cxy = cloud(spark, 40, 0.0, seed=9)
    best = np.sqrt(((xy[:, None] - cxy[None]) ** 2).sum(2).min(1))
    cen = sampling.as_centres(c, ["g"])
    got = sampling.nearest_presence(d, cen, ["g"], "id", 500.0, 3000.0)
    for r in got.collect():
        want = best[r["id"]]
        assert r["nearest_presence_km"] is None if want > 3000 else abs(r["nearest_presence_km"] * 1000 - want) < 1e-6
    ring = sampling.in_annulus(d, cen, ["g"], "id", 1000.0, 2500.0)
    assert sorted(r["id"] for r in ring.collect()) == [i for i in range(200) if 1000 <= best[i] <= 2500]


GRID = (-180.0, 90.0, 1 / 128, 1 / 128)


@pytest.mark.parametrize("mode", ["radial", "polygon"])
def test_background_properties(spark, mode):
    g = np.random.default_rng(0)
    pts = [("a" if i % 4 else "b", i, float(40 + g.normal(0, 0.5)), float(-100 + g.normal(0, 0.5))) for i in range(80)]
    p = spark.createDataFrame(pts, "species string, id long, lat double, lon double").withColumn("k", order_key(1, F.col("id")))
    p = sampling.thin_to_cell(p, GRID, ["species"], "k")
    fn = sampling.background_radial if mode == "radial" else sampling.background_polygon
    b = fn(p, ["species"], "k", GRID, 40.0, 5.0).cache()
    n = {r["species"]: r["count"] for r in p.groupBy("species").count().collect()}
    assert {r["species"]: r["count"] for r in b.groupBy("species").count().collect()} == n
    assert b.select("species", "cell_row", "cell_col").distinct().count() == b.count()
    assert b.join(p, ["species", "cell_row", "cell_col"]).count() == 0
    lo, hi = b.agg(F.min("nearest_presence_km"), F.max("nearest_presence_km")).first()
    assert 5.0 <= lo and hi <= 40.0
    with pytest.raises(ValueError):
        fn(p, ["species"], "k", GRID, 5.0, 5.0)


def test_background_gives_up(spark):
    p = spark.createDataFrame([("a", 1, 40.003, -100.003)], "species string, id long, lat double, lon double").withColumn("k", order_key(1, F.col("id")))
    p = sampling.thin_to_cell(p, GRID, ["species"], "k")
    with pytest.raises(RuntimeError, match="not enough free background cells"):
        sampling.background_radial(p, ["species"], "k", GRID, 0.001, 0.0, max_rounds=2)


def test_split_counts_and_leftover(spark):
    d = spark.createDataFrame([(i, i % 2) for i in range(30)], "id long, presence int").withColumn("s", F.lit("a"))
    d = d.withColumn("k", order_key(1, F.col("id"))).withColumn("fold", (F.col("id") % 2 + 2).cast("int"))
    u = splits.stratified_split(d, ["s"], "k", 0.7, 0.15)
    # 15 per class: round(10.5) = 10, round(2.25) = 2, the rest is tested.
    assert rows(u.groupBy("presence", "split").count()) == [(0, "test", 3), (0, "train", 10), (0, "val", 2), (1, "test", 3), (1, "train", 10), (1, "val", 2)]
    # Round 1 holds nothing out: 15 = 10 train + 4 val + 1 left over.
    new = splits.cv_rounds(d, ["s"], "k", 1).groupBy("presence", "split").count()
    old = splits.cv_rounds(d, ["s"], "k", 1, legacy_remainder=True).groupBy("presence", "split").count()
    assert rows(new) == [(0, "train", 10), (0, "val", 5), (1, "train", 10), (1, "val", 5)]
    assert rows(old) == [(0, "test", 1), (0, "train", 10), (0, "val", 4), (1, "test", 1), (1, "train", 10), (1, "val", 4)]


def test_each_point_is_tested_once(spark):
    d, _ = cloud(spark, 200)
    d = d.withColumn("presence", (F.col("id") % 3 == 0).cast("int"))
    f = splits.assign_folds(splits.spatial_blocks(d, ["g"], 3000.0), ["g"], 4, 42)
    cv = splits.cv_rounds(f, ["g"], "k", 4)
    tested = cv.groupBy("id").agg(F.count_if(F.col("split") == "test").alias("n"))
    assert {r["n"] for r in tested.collect()} == {1}
    assert f.groupBy("block_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_rank_does_not_depend_on_partitions(spark):
    d, _ = cloud(spark, 300)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(ranks.exact_rank(d.repartition(int(n)), ["g"], "k"), "id", "rank"))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1]
    want = {r["id"]: i for i, r in enumerate(d.orderBy("k").collect())}
    assert dict(got[0]) == want


def test_quantiles_and_buckets(spark):
    g = np.random.default_rng(2)
    v = np.concatenate([g.normal(0, 1, 400), np.zeros(50), g.uniform(0, 1e-9, 50), [1e12, -1e12, 1.0, 0.5]])
    d = spark.createDataFrame([(0, float(x)) for x in v], "g int, v double")
    got = ranks.quantiles(d, ["g"], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 1.0}).first()
    assert np.allclose([got["a"], got["b"], got["c"], got["d"]], np.quantile(v, [0, 0.25, 0.5, 1]))
    c, f = ranks.value_buckets(F.col("v"))
    seq = [(r["c"], r["f"]) for r in d.select("v", c.alias("c"), f.alias("f")).orderBy("v").collect()]
    assert seq == sorted(seq)


def scored(spark, data):
    d = spark.createDataFrame(data, "s string, true_label int, probability double")
    return d.withColumn("predicted_label", metrics.predicted_class(F.col("probability")))


def test_metrics_edges(spark):
    d = scored(spark, [("one", 1, 0.9), ("one", 1, 0.2), ("tie", 1, 0.5), ("tie", 0, 0.5), ("mix", 1, 0.8), ("mix", 0, 0.6), ("mix", 1, 0.4), ("mix", 0, 0.1)])
    r = {x["s"]: x for x in metrics.full_summary(d, ["s"]).collect()}
    assert r["one"]["specificity"] is None and r["one"]["mcc"] is None and r["one"]["roc_auc"] is None and r["one"]["brier"] is None
    assert r["one"]["sensitivity"] == 0.5 and r["one"]["average_precision"] is None
    # All scores tie at the threshold: everything is predicted present.
    assert r["tie"]["roc_auc"] == 0.5 and r["tie"]["mcc"] == 0.0 and r["tie"]["specificity"] == 0.0 and r["tie"]["precision"] == 0.5
    assert r["mix"]["roc_auc"] == 0.75 and r["mix"]["mcc"] == 0.0 and math.isclose(r["mix"]["average_precision"], 0.5 + 0.5 * 2 / 3)
    assert metrics.roc_curve(d.filter("s = 'one'"), ["s"]).count() == 0
    assert metrics.full_summary(d.filter("s = 'none'"), ["s"]).count() == 0


def test_auc_equals_pair_counting(spark):
    g = np.random.default_rng(1)
    y, p = g.integers(0, 2, 120), np.round(g.uniform(0, 1, 120), 1)
    d = scored(spark, [("a", int(a), float(b)) for a, b in zip(y, p)])
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
    assert math.isclose(metrics.roc_auc(d, ["s"]).first()["roc_auc"], want)


def test_running_best_sequence(spark):
    seq = [0.5, None, 0.4, 0.6, 0.6, 0.7]
    data = [("b", f"20260101_00000{i}", v) for i, v in enumerate(seq)]
    d = spark.createDataFrame(data, "benchmark_name string, run_id string, mean_val_mcc double")
    got = trials.best_so_far(d).orderBy("trial").collect()
    assert [r["is_new_best"] for r in got] == [True, False, False, True, True, True]
    assert [r["is_repeat_best"] for r in got] == [True, False, False, True, True, False]
    assert [r["best_so_far_mcc"] for r in got] == [0.5, None, 0.5, 0.6, 0.6, 0.7]


def test_early_stop(spark):
    losses = [1.0, 0.8, float("nan"), 0.9, 0.8, 0.7, 0.6]
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(losses)], "run_id long, epoch int, val_loss double")
    r = metrics.early_stop(d, 3).first()
    assert (r["stop_epoch"], r["best_epoch"], r["best_val_loss"], r["n_checkpoints"]) == (4, 1, 0.8, 3)
    assert metrics.early_stop(d, 10).first()["stop_epoch"] is None


def test_text(spark):
    d = spark.createDataFrame([("  Quercus 2b-x! ", "d\\e/Acer_rubrum_thinned.csv", 0.000175), (None, "Pinus_thin2.csv", 123456.0)], "s string, p string, v double")
    got = d.select(
        text.slug(F.col("s")).alias("slug"), text.species_slug_from_path(F.col("p")).alias("sp"), text.general_number(F.col("v"), 2).alias("g"),
        text.title_case(F.lit("quercus 2b x")).alias("t"), text.display_name(F.lit("acer__2b_x")).alias("n"),
    ).collect()
    assert [tuple(r) for r in got] == [("quercus_2b_x", "acer_rubrum", "0.00017", "Quercus 2B X", "Acer_2b_X"), (None, "pinus", "1.2e+05", "Quercus 2B X", "Acer_2b_X")]
    nums = spark.createDataFrame([("1.0d",), ("NaN",), (" 5e-3 ",), ("-.5",), ("",), ("0x10",)], "s string")
    assert [r[0] for r in nums.select(text.to_number(F.col("s"))).collect()] == [None, None, 0.005, -0.5, None, None]


def test_names():
    assert names.canonical_family(" NAIP_Climate ") == "image_tabular"
    assert names.family_inputs("full") == {"image", "topo", "tabular"}
    with pytest.raises(ValueError):
        names.canonical_family("other")
    assert clean.resolve_predictors(["ghm", "lat_norm", "elev_sd", "x"]) == ["ghm", "lat_norm", "elev_sd"]
    assert clean.resolve_predictors(["a", "b"], '["b", "a"]') == ["b", "a"]
    assert clean.resolve_predictors(["a", "b"], "a, b") == ["a", "b"]
    for bad in (["nearest_presence_km"], ["missing"]):
        with pytest.raises(ValueError):
            clean.resolve_predictors(["nearest_presence_km"], bad)


def test_occurrence_files(spark, tmp_path):
    (tmp_path / "Acer_rubrum_thinned.csv").write_text("decimalLatitude,LAT,decimalLongitude,Source\n40.5,1,-100,GBIF\nNA,1,-100,x\n91,1,-100,x\n41,1,-101,\n")
    (tmp_path / "pinus.csv").write_text("lat,Long,species,uncertainty\n40,-90,Pinus sp,10\n40,-91,Pinus sp,500\n40,-92,Pinus sp,\n")
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    got, failed, rejected = occurrences.read_occurrences(spark, str(tmp_path), max_uncertainty_m=100.0)
    assert rows(got, "species", "source", "lat", "lon") == [("Acer Rubrum", "GBIF", 40.5, -100.0), ("Acer Rubrum", "unknown", 41.0, -101.0), ("Pinus sp", "unknown", 40.0, -90.0)]
    assert len(failed) == 1 and failed[0][0].endswith("bad.csv")
    assert rejected.count() == 2


def test_raster_listing(spark, tmp_path):
    for p in ("a/M_1.tif", "b/m_1.TIF", "b/x.txt", "M_2.tif"):
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"x")
    listed = catalog.list_rasters(spark, str(tmp_path))
    assert listed.count() == 3
    got = {r["name"]: r["path"] for r in catalog.raster_file_catalog(listed).collect()}
    assert set(got) == {"m_1.tif", "m_2.tif"} and got["m_1.tif"].endswith("b/m_1.TIF")


def test_stats_files(spark, tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"stats": {"a": {"mean": 1.5, "std": 2.0}, "b": {"mean": 0, "std": 0}}}')
    d = stats.read_stats(spark, str(f))
    assert rows(d.filter("var = 'a'"), "mean", "std") == [(1.5, 2.0)]
    with pytest.raises(ValueError, match="unusable"):
        stats.check_stats(d, ["a", "b"])
    with pytest.raises(ValueError, match="no statistics"):
        stats.check_stats(d, ["c"])


def test_existing_target_is_refused(spark):
    path = scratch_path(spark, "t")
    d = spark.createDataFrame([("a", 1)], "species string, v int")
    tables.write_table(d, path, "points")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        tables.write_table(d, path, "points")


def test_tile_border_is_outside(spark):
    t = spark.createDataFrame([(1, "a", "u", 0.0, 0.0, 1.0, 1.0), (2, "b", "u", 0.5, 0.5, 2.0, 2.0)], "tile_id long, filename string, url string, minx double, miny double, maxx double, maxy double")
    p = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.7, 0.7), (3, 1.0, 1.0), (4, 5.0, 5.0)], "id long, lon double, lat double")
    assert rows(spatial.attach_tile(p, t, "id"), "id", "tile_id")[1:3] == [(2, 1), (3, 2)]
    assert {r["id"] for r in spatial.attach_tile(p, t, "id").filter("tile_id IS NULL").collect()} == {1, 4}
    assert rows(spatial.in_footprint(p, t, "id"), "id") == [(1,), (2,), (3,)]


def test_chip_past_the_edge_and_first_tile_wins(spark):
    t = spark.createDataFrame([(1, "A", 0.0, 0.0, 1.0, 4, 4, 0.0, -4.0, 4.0, 0.0), (2, "A", 2.0, 0.0, 1.0, 4, 4, 2.0, -4.0, 6.0, 0.0)], "tile_id long, crs string, x0 double, y0 double, px_size double, h int, w int, minx double, miny double, maxx double, maxy double")
    one = [(1, 0, r, c, 0.0 if (r, c) == (1, 3) else 1.0) for r in range(4) for c in range(4)]
    two = [(2, 0, r, c, 2.0) for r in range(4) for c in range(4)]
    px = spark.createDataFrame(one + two, "tile_id long, band int, r long, c long, v double")
    blocks = rasters.to_blocks(px, ["tile_id"], "band", 1, 2)
    s = spark.createDataFrame([(7, 3.5, -0.5)], "sample_id long, x double, y double")
    need = rasters.chip_window_blocks(rasters.chip_windows(s, t, 4, 8.0), t, 4, 2, 8.0)
    chip = np.array(rasters.assemble_chips(need, blocks, 4, 2, 1).first()["px"]).reshape(4, 4)
    assert chip.tolist() == [[0, 0, 0, 0], [0, 0, 0, 0], [1, 1, 1, 2], [1, 1, 2, 2]]
    mixed = t.withColumn("crs", F.when(F.col("tile_id") == 2, "B").otherwise("A"))
    assert rasters.chip_window_blocks(rasters.chip_windows(s, t, 4, 8.0), mixed, 4, 2, 8.0).count() == 0


def test_rotation_kernel():
    a = np.arange(32.0).reshape(2, 4, 4)
    assert np.allclose(rasters.rotate_kernel(a, 0.0), a)
    assert np.allclose(rasters.rotate_kernel(a, 90.0), np.rot90(a, 1, (1, 2)))
    assert rasters.rotate_kernel(np.ones((1, 8, 8)), 45.0)[0, 0, 0] == 0.0


def test_scorer_and_dropout(spark):
    w = models.mlp_weights(3, (8, 8, 4), 1)
    x = np.random.default_rng(0).normal(size=(40, 3))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, f array<double>")
    got = {r["id"]: r["logit"] for r in models.score_mlp(d.repartition(3), "id", "f", w).collect()}
    h = x
    for i in range(2):
        h = np.maximum(h @ w[f"w{i}"] + w[f"b{i}"], 0)
        h = (h - h.mean(1)[:, None]) / np.sqrt(((h - h.mean(1)[:, None]) ** 2).mean(1) + 1e-5)[:, None]
    want = np.maximum(h @ w["w2"] + w["b2"], 0) @ w["w3"] + w["b3"]
    assert np.allclose([got[i] for i in range(40)], want[:, 0])
    a = rows(models.score_mlp(d.repartition(1), "id", "f", w, 3, 0.5, 7).withColumn("logit", F.round("logit", 9)))
    b = rows(models.score_mlp(d.repartition(5), "id", "f", w, 3, 0.5, 7).withColumn("logit", F.round("logit", 9)))
    assert a == b and len(a) == 120 and len({v for _, _, v in a}) > 40


def test_small_tiles_have_no_chips(spark):
    t = spark.createDataFrame([(1, 100, 600), (2, 256, 256), (3, 600, 300)], "tile_id long, height long, width long")
    assert rows(tiles.chip_grid(t, 256, 256).groupBy("tile_id").count()) == [(2, 1), (3, 2)]
    m = tiles.overlap_mosaic(tiles.chip_grid(t, 256, 256).withColumn("mean_p", F.lit(0.5)).withColumn("std_p", F.lit(0.1)), 256, 256)
    full = tiles.with_uncovered(m, t, 256)
    assert full.filter("tile_id = 3 AND n_chips = 0 AND prediction = -9999").count() == 4


def test_mosaic_squares_equal_pixels(spark):
    t = spark.createDataFrame([(1, 10, 12)], "tile_id long, height long, width long")
    c = tiles.chip_grid(t, 4, 2).withColumn("mean_p", (F.col("row") * 3 + F.col("col")) / 50.0).withColumn("std_p", F.lit(0.0))
    total, n = np.zeros((10, 12)), np.zeros((10, 12))
    for r in c.collect():
        total[r["row"] : r["row"] + 4, r["col"] : r["col"] + 4] += r["mean_p"]
        n[r["row"] : r["row"] + 4, r["col"] : r["col"] + 4] += 1
    for r in tiles.overlap_mosaic(c, 4, 2).collect():
        y, x = r["cell_row"] * 2, r["cell_col"] * 2
        assert np.allclose(total[y : y + 2, x : x + 2] / n[y : y + 2, x : x + 2], r["prediction"]) and n[y, x] == r["n_chips"]


def test_predicates_on_bad_numbers(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (2, float("nan"), 2.0), (3, 1.0, float("inf")), (4, None, 1.0), (5, 101.0, 1.0)], "id long, a double, b double")
    assert rows(clean.valid_env(d, ["a", "b"]), "id") == [(1,)]
    assert rows(clean.env_vector(d, ["a", "b"]).filter("usable"), "id") == [(1,), (5,)]
    assert rows(clean.fill_vector(d, ["a", "b"]).filter("id in (2, 3)"), "features") == [([0.0, 2.0],), ([1.0, 0.0],)]
    assert rows(clean.uncertainty_filter(d, None, 10.0), "id") == [(1,), (2,), (3,), (4,), (5,)]


def test_statistics_of_repeated_and_unasked_names(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 2.0), ("a", 1.5, 2.0), ("b", 0.0, 1.0), ("c", 0.0, 0.0)], "var string, mean double, std double")
    assert stats.check_stats(d, ["a", "b"]).count() == 5
    with pytest.raises(ValueError, match=r"no statistics for \['d'\]"):
        stats.check_stats(d, ["a", "d"])


def test_zscores_pair_by_layer_number(spark):
    d = spark.createDataFrame([(1, [5.0, 7.0])], "id int, values array<double>")
    s = spark.createDataFrame([(1, 1.0, 2.0), (0, 3.0, 4.0)], "layer long, mean double, std double")
    assert rows(rasters.zscore_values(d, s), "values") == [([0.5, 3.0],)]
    with pytest.raises(Exception, match="no usable statistics for layer 1"):
        rasters.zscore_values(d, s.filter("layer = 0")).collect()
    with pytest.raises(Exception, match="no usable statistics for layer 0"):
        rasters.zscore_values(d, s.withColumn("std", F.lit(0.0))).collect()


def test_scores_that_are_missing_count_nowhere(spark):
    d = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), (None, 1, None), (None, 0, float("nan"))], "eval_set int, true_label int, probability double")
    assert rows(metrics.roc_auc(d, ["eval_set"])) == [(None, 1.0)]
    assert rows(metrics.average_precision(d, ["eval_set"])) == [(None, 1.0)]


def test_null_groups_are_groups(spark):
    d = spark.createDataFrame([(None, 1, "b"), (None, 2, "a"), ("x", 3, "c")], "g string, i int, k string")
    assert sorted((r.i, r["rank"]) for r in ranks.exact_rank(d, ["g"], "k").collect()) == [(1, 1), (2, 0), (3, 0)]
    p = spark.createDataFrame([(None, 0.0, 0.0), (None, 25.0, 5.0)], "g string, x double, y double")
    assert rows(splits.spatial_blocks(p, ["g"], 10.0), "block_id") == [("0_0",), ("2_0",)]
    q = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 5.0)], "g string, v double")
    assert {r.g: r.m for r in ranks.quantiles(q, ["g"], "v", {"m": 0.5}).collect()} == {None: 2.0, "x": 5.0}


def test_hot_keys_are_relative_and_complete(spark):
    d = spark.createDataFrame([(i % 3 if i < 90 else i,) for i in range(120)], "k long")
    assert rows(joins.hot_keys(d, ["k"], hot_rows=10), "k", "_salts") == [(0, 3), (1, 3), (2, 3)]


def test_zone_box_is_wide_enough_in_the_north(spark):
    d = spark.createDataFrame([(1, 68.0, 20.0), (2, 10.0, 20.0), (3, 85.0, 20.0)], "g int, lat double, lon double")
    box = {r.g: r for r in sampling.zone_box(d, ["g"], 50_000.0).collect()}
    for g, lat in ((1, 68.0), (2, 10.0), (3, 85.0)):
        assert box[g].x2 - 20.0 >= 50.0 / (111.4 * math.cos(math.radians(lat + 0.44)))


def test_title_case_beyond_ascii(spark):
    d = spark.createDataFrame([("são tomé-príncipe 2b " + "x" * 1_100_000,)], "s string")
    got = d.select(text.title_case(F.col("s"))).first()[0]
    assert got.startswith("São Tomé-Príncipe 2B X") and len(got) == len("são tomé-príncipe 2b ") + 1_100_000


def test_csv_with_quotes_line_breaks_and_header_commas(spark, tmp_path):
    (tmp_path / "quercus_alba.csv").write_text('"note, free",lat,lon\n"He said ""oak"", tall",40.0,-80.0\n"two\nlines",41.0,-81.0\nplain,42.0,-82.0\nbad,#N/A N/A,-83\n')
    got, failed, rejected = occurrences.read_occurrences(spark, str(tmp_path))
    assert rows(got, "lat", "lon") == [(40.0, -80.0), (41.0, -81.0), (42.0, -82.0)] and not failed and rejected.count() == 1


def test_writing_again_replaces_folders(spark):
    path = scratch_path(spark, "t")
    d = spark.createDataFrame([("a", 1), ("b", 2)], "species string, v int")
    tables.write_table(d, path, "points")
    tables.write_table(d.filter("species = 'a'").withColumn("v", F.lit(3)), path, "points", allow_existing=True)
    assert rows(tables.read_partition(spark, path), "species", "v") == [("a", 3), ("b", 2)]


def test_random_points_are_exactly_as_many_as_asked(spark):
    seeds = spark.range(10).withColumnRenamed("id", "s")
    got = sampling.random_points(seeds, "s", 4, (0.0, 0.0, 1.0, 1.0), lambda x, y: x + y < 0.5, 1, 30)
    assert got.count() == 30
    with pytest.raises(RuntimeError, match="fewer than"):
        sampling.random_points(seeds, "s", 1, (0.0, 0.0, 1.0, 1.0), lambda x, y: x > 2, 1, 1, 2)


def test_short_species_do_not_stop_the_others(spark):
    grid = (-180.0, 90.0, 0.5, 0.5)
    d = spark.createDataFrame([("ok", 40.0, -100.0), ("crowd", 41.0, -90.0)] + [("crowd", 41.0 + 0.5 * a, -90.0 + 0.5 * b) for a in range(-2, 3) for b in range(-2, 3) if a or b], "species string, lat double, lon double")
    d = sampling.with_cell(d, grid).withColumn("k", order_key(1, F.concat_ws(":", "lat", "lon")))
    short: list = []
    got = sampling.background_radial(d, ["species"], "k", grid, 60.0, 0.0, max_rounds=1, multiplier=3.0, short=short)
    done = {r.species for r in got.select("species").distinct().collect()}
    missing = {r.species for r in short[0].collect()} if short else set()
    assert done.isdisjoint(missing) and done | missing == {"ok", "crowd"}


def test_sorted_rank_spreads_a_group_without_leading_values(spark):
    d = spark.createDataFrame([(None if i % 5 else "b", None, i * 7919 % 1000) for i in range(1000)], "g string, t int, k int").repartition(7)
    got = ranks.sorted_rank(d, ["g"], [F.col("t").asc_nulls_last(), F.col("k").asc()], "rank").collect()
    for g in (None, "b"):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))


def test_rings_with_holes_by_cells(spark):
    import random

    rng = random.Random(8)
    star = [((1.5 if k % 2 else 0.5) * math.cos(k * math.pi / 7) + 2, (1.5 if k % 2 else 0.5) * math.sin(k * math.pi / 7) + 2) for k in range(14)]
    shapes = {1: [star], 2: [[(0, 0), (3, 0), (3, 3), (0, 3)], [(1, 1), (2, 1), (2, 2), (1, 2)]], 3: [[(3, 3), (3.01, 3), (3.01, 3.01)]]}
    edges = [(i, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for i, rings in shapes.items() for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]
    pts = [(k, rng.uniform(-0.5, 4), rng.uniform(-0.5, 4)) for k in range(600)] + [(600, 3.007, 3.004)]

    def holds(i, x, y):
        return sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for t, ax, ay, bx, by in edges if t == i) % 2 == 1

    want = {k: min((i for i in shapes if holds(i, x, y)), default=None) for k, x, y in pts}
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    tiles = spark.createDataFrame([(i, f"f{i}", "u") for i in shapes], "tile_id long, filename string, url string")
    for depth in (0, 4):
        cover = spatial.ring_cover(spark.createDataFrame(edges, "tile_id long, ax double, ay double, bx double, by double"), side=0.5, depth=depth)
        assert {r["id"]: r["tile_id"] for r in spatial.attach_ring_tile(points, tiles, cover, "id").collect()} == want
        assert {r["id"] for r in spatial.in_ring_footprint(points, cover, "id").collect()} == {k for k, t in want.items() if t}
    assert cover.filter("edges IS NULL").count() > 0
    none = spatial.ring_cover(spark.createDataFrame([], "tile_id long, ax double, ay double, bx double, by double"))
    assert spatial.in_ring_footprint(points, none, "id").count() == 0


def test_zone_area_by_row_intervals(spark):
    import random

    rng = random.Random(9)
    pts = [(["a", "b", None][k % 3], rng.uniform(0, 40), rng.uniform(0, 40)) for k in range(40)]
    got = {r["g"]: r["area_km2"] for r in spatial.sampling_area_km2(spark.createDataFrame(pts, "g string, x double, y double"), ["g"], 2.5, 9.0, 1.0).collect()}
    for g in ("a", "b", None):
        own = [(x, y) for h, x, y in pts if h == g]
        far = [min((i + 0.5 - x) ** 2 + (j + 0.5 - y) ** 2 for x, y in own) for i in range(-12, 54) for j in range(-12, 54)]
        assert got[g] == pytest.approx(sum(6.25 <= d <= 81 for d in far) / 1e6)


def test_whole_groups_keep_rows_of_a_key_together():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 2])], ["k"]) for a in range(0, 10, 2)]
    parts = [t.column("k").to_pylist() for t in rasters.whole_groups(iter(batches), "k", 3)]
    assert sum(parts, []) == keys and len(parts) > 1
    assert all(not set(a) & set(b) for a, b in zip(parts, parts[1:], strict=False))


def test_resampling_shares_weights_among_known_pixels(spark):
    blocks = spark.createDataFrame([(0, 0, [1.0, 2.0, None, 4.0])], "block_row long, block_col long, px array<double>")
    windows = spark.createDataFrame([(1, 0.0, 0.0, 2.0, -2.0), (2, 6.0, 0.0, 8.0, -2.0)], "sample_id long, left double, top double, right double, bottom double")
    got = {r["sample_id"]: r["px"] for r in rasters.resample_topo(windows, blocks, (0.0, 0.0, 1.0, 1.0), 1, 2, 1).collect()}
    assert got == {1: [pytest.approx(7 / 3)], 2: [None]}


def test_nearest_over_empty_and_crowded_areas(spark):
    d, xy = cloud(spark, 150)
    g = np.random.default_rng(5)
    # A crowd far from most points, a few single centres, and a point and a centre without a place.
    cxy = np.concatenate([g.normal(90000, 200, (400, 2)), g.uniform(-60000, 60000, (6, 2)), xy[:1]])
    c = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(cxy)] + [(999, None, 0.0)], "id long, x double, y double").withColumn("g", F.lit(0))
    d = d.unionByName(spark.createDataFrame([(900, 80000.0, 70000.0, 0, "k"), (901, None, None, 0, "k"), (902, 5.0, 5.0, 7, "k")], "id long, x double, y double, g int, k string"))
    cen = sampling.as_centres(c, ["g"])
    for start, outer in ((40.0, 200000.0), (3000.0, 30000.0), (5000.0, 5000.0)):
        got = {r["id"]: r["nearest_presence_km"] for r in sampling.nearest_presence(d, cen, ["g"], "id", start, outer).collect()}
        assert len(got) == 153 and got[901] is None and got[902] is None
        for i, p in [*enumerate(xy), (900, np.array([80000.0, 70000.0]))]:
            want = np.sqrt(((cxy - p) ** 2).sum(1).min())
            assert got[i] is None if want > outer else abs(got[i] * 1000 - want) < 1e-6


def test_turned_chips_of_training_rows(spark):
    g = np.random.default_rng(1)
    chips = g.uniform(1, 9, (40, 2 * 5 * 6)).round(3)
    rows_in = [(i, "train" if i % 4 else "test", None if i == 5 else [None if k == i else float(v) for k, v in enumerate(c)]) for i, c in enumerate(chips)]
    d = spark.createDataFrame(rows_in, "id long, split string, px array<double>").repartition(3)
    got = {r["id"]: r for r in rasters.augment(d, "id", {"px": (2, 5, 6)}, 3, 45.0, 0.5, 0.5, F.col("split") == "train", {"px": (0, 1)}).collect()}
    for i, split, px in rows_in:
        r = got[i]
        if split == "test" or px is None:
            assert r["px"] == px
            continue
        want = rasters.rotate_kernel(np.array([v or 0.0 for v in px]).reshape(2, 5, 6), r["angle"])
        want = want[:, :, ::-1] if r["hflip"] else want
        want = want[:, ::-1] if r["vflip"] else want
        t = np.deg2rad(r["angle"])
        n, e = want[0], want[1]
        e2 = (np.cos(t) * e - np.sin(t) * n) * (-1 if r["hflip"] else 1)
        n2 = (np.sin(t) * e + np.cos(t) * n) * (-1 if r["vflip"] else 1)
        assert np.allclose(np.array(r["px"]).reshape(2, 5, 6), np.stack([n2, e2]))
    assert {got[i]["hflip"] for i in got if i % 4} == {True, False}
    assert rasters.augment(d.filter("id < 0"), "id", {"px": (2, 5, 6)}, 3, 45.0, 0.5, 0.5).count() == 0


def test_vectors_turn_with_the_pixels():
    # A field that points north everywhere points west after a quarter turn counter-clockwise.
    field = np.zeros((1, 2, 3, 3))
    field[:, 0] = 1.0
    no, quarter = np.array([False]), np.array([90.0])
    out = rasters.augment_batch(field, quarter, no, no)
    rasters.turn_vectors(out, 0, 1, quarter, no, no)
    assert np.allclose(out[0, 0], 0.0) and np.allclose(out[0, 1], -1.0)


def test_statistics_from_stored_moments(spark):
    g = np.random.default_rng(2)
    px = [(b, y, x, None if (b + y + x) % 7 == 0 else float(g.normal(1e6 * b, 3))) for b in (0, 1) for y in range(8) for x in range(8)]
    pixel = spark.createDataFrame(px, "layer int, r long, c long, v double")
    blocks = rasters.to_blocks(pixel, [], "layer", 2, 4)
    moments = rasters.block_moments(blocks, 2, 4).cache()
    want = {r["layer"]: r for r in rasters.layer_stats(pixel).collect()}
    for r in rasters.merge_moments(moments.drop("block_row", "block_col")).collect():
        assert r["count"] == want[r["layer"]]["count"] and abs(r["std"] - want[r["layer"]]["std"]) < 1e-9 and abs(r["mean"] - want[r["layer"]]["mean"]) < 1e-6
    # One tile over the first block and half of the next: pixels of the far blocks may not count, nor be read.
    tiles_in = spark.createDataFrame([(0.0, -4.0, 6.0, 0.0)], "minx double, miny double, maxx double, maxy double")
    got = {r["layer"]: r for r in rasters.footprint_stats(blocks, moments, tiles_in, (0.0, 0.0, 1.0, 1.0), 2, 4).collect()}
    for b in (0, 1):
        v = [p[3] for p in px if p[0] == b and p[1] < 4 and p[2] < 6 and p[3] is not None]
        assert got[b]["count"] == len(v) and abs(got[b]["mean"] - np.mean(v)) < 1e-6 and abs(got[b]["std"] - np.std(v)) < 1e-9


def test_statistics_are_computed_once(spark):
    path, calls = scratch_path(spark, "kept"), []

    def compute(std=2.0):
        calls.append(std)
        return spark.createDataFrame([("a", 1.0, std, 0.0, 3.0, 5)], "var string, mean double, std double, min double, max double, count long")

    with pytest.raises(ValueError):
        stats.stored_stats(spark, path, ["a"], lambda: compute(0.0))
    first = rows(stats.stored_stats(spark, path, ["a"], compute, "stats"))
    assert rows(stats.stored_stats(spark, path, ["a"], compute)) == first and calls == [0.0, 2.0]


def test_family_spellings(spark):
    assert names.canonical_family("HostNAIPTopoClimateModel") == "image_topo_tabular"
    d = spark.createDataFrame([(" Climate_Only ",), ("HostTopoOnlyModel",), (None,)], "m string")
    assert rows(d.select(names.family_column(F.col("m")).alias("f")).filter("f IS NOT NULL")) == [("tabular_only",), ("topo_only",)]
    with pytest.raises(Exception, match="unknown model family"):
        spark.createDataFrame([("hosttopoonlymodel",)], "m string").select(names.family_column(F.col("m"))).collect()


def test_scoring_resumes_and_keeps_errors_apart(spark):
    path, seen = scratch_path(spark, "scores"), []
    tiles_in = spark.createDataFrame([(1, 8, 8), (2, 8, 8), (3, None, 8), (4, 2, 2)], "tile_id long, height long, width long")
    one = [float(v) for v in range(1, 17)]
    cut = [(t, r, c, one if c else [0.0] * 16, one) for t in (1, 2) for r in (0, 2, 4) for c in (0, 2, 4) if (t, r, c) != (2, 4, 4)]
    schema = "tile_id long, row long, col long, px array<double>, topo array<double>"

    def scorer(d):
        seen.append(sorted({r[0] for r in d.select("tile_id").collect()}))
        return d.select("tile_id", "row", "col", (F.col("row") / 8).alias("probability"))

    def run(chips):
        scoring.score_tiles(tiles_in, spark.createDataFrame(chips, schema), path, "image_topo", [], scorer, 4, 4, 4, 2)
        return {r["tile_id"]: r.asDict() for r in scoring.last_log(spark, path).collect()}, scoring.read_scores(spark, path)

    assert scoring.read_scores(spark, path).count() == 0
    log, squares = run(cut)
    assert [log[t]["status"] for t in (1, 2, 3, 4)] == ["ok", "error", "error", "ok"]
    assert log[2]["error"] == "chips missing: 1" and log[3]["error"] == "unusable size"
    assert (log[1]["processed_chips"], log[1]["skipped_image_chips"]) == (6, 3)
    # Four by four squares; the left column of chips is dark, so its outer squares are covered by none.
    of = {(r["tile_id"], r["cell_row"], r["cell_col"]): r for r in squares.collect()}
    assert len(of) == 16 + 1 and of[1, 0, 0]["n_chips"] == 0 and of[1, 0, 0]["prediction"] == tiles.NODATA
    assert of[1, 1, 1]["n_chips"] == 2 and abs(of[1, 1, 1]["prediction"] - 0.125) < 1e-12 and of[4, 0, 0]["n_chips"] == 0
    # Squares of a run that ended before its log are not read; the next run scores only what has no result.
    tables.write_mosaic(squares.withColumn("tile_id", F.lit(2).cast("long")), f"{path}/mosaic/{'0' * 32}")
    log, squares = run([*cut, (2, 4, 4, one, one)])
    assert seen == [[1], [2]] and [log[t]["status"] for t in (1, 2, 3, 4)] == ["ok", "ok", "error", "ok"]
    assert squares.groupBy("tile_id").count().count() == 3 and squares.count() == 33


def test_southern_tiles(spark):
    d = spark.createDataFrame([(1, 256, 256, 300000.0, 6000000.0, 1.0, 19, False), (2, 256, 256, 300000.0, 4000000.0, 1.0, 19, True)],
        "tile_id long, height long, width long, x0 double, y0 double, px_size double, zone int, north boolean")
    got = {r["tile_id"]: r for r in tiles.chip_centre(tiles.chip_grid(d, 256, 128), 256).collect()}
    assert abs(got[1]["lat"] + got[2]["lat"]) < 0.01 and got[1]["lat"] < -35 and abs(got[1]["lon"] - got[2]["lon"]) < 0.01
    x, y = geo.utm_xy(F.lit(0.001), F.lit(-69.0), F.lit(19), F.lit(False))
    assert abs(spark.range(1).select(y).first()[0] - 10_000_110.5) < 1.0
    chips = tiles.chip_grid(d, 256, 128).withColumns({"mean_p": F.lit(0.5), "std_p": F.lit(0.1)})
    out = tiles.mosaic_reproject(tiles.overlap_mosaic(chips, 256, 128), d, 128, 60.0)
    per = {r["tile_id"]: r for r in out.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("p"), F.max("gy").alias("gy")).collect()}
    # Half of the tile's 256 x 256 metres lie in pixels of 60 metres, whichever the hemisphere.
    assert all(10 <= per[t]["n"] <= 40 and abs(per[t]["p"] - 0.5) < 1e-9 for t in (1, 2)) and per[1]["gy"] < 0 < per[2]["gy"]


def test_a_window_opens_few_files(spark, tmp_path):
    import pyarrow.parquet as pq

    side = 64
    d = spark.range(side * side).select((F.floor(F.col("id") / side) - 32).alias("block_row"), (F.col("id") % side - 32).alias("block_col"), F.array(F.rand(1)).alias("px"))
    path = str(tmp_path / "blocks")
    block_files.write_blocks(d, path, 16)
    window = [(-20, -13), (3, 10)]
    opened, files = 0, list((tmp_path / "blocks").glob("*.parquet"))
    for f in files:
        m = pq.ParquetFile(f).metadata
        ranges = []
        for name in ("block_row", "block_col"):
            st = [m.row_group(g).column(m.schema.to_arrow_schema().names.index(name)).statistics for g in range(m.num_row_groups)]
            ranges.append((min(x.min for x in st), max(x.max for x in st)))
        opened += all(lo <= w[1] and hi >= w[0] for (lo, hi), w in zip(ranges, window))
    assert len(files) == 16 and opened <= 5
    got = block_files.read_blocks(spark, path, *window)
    assert got.count() == 64 and block_files.read_blocks(spark, path).count() == d.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block_row,-20)" in plan


def test_mosaic_and_blocks_spread_by_their_size(spark, monkeypatch):
    # Squares and pixels are shuffled before they are grouped, to a number of tasks that follows theirs.
    t = spark.createDataFrame([(k, 8, 8) for k in range(6)], "tile_id long, height long, width long")
    chips = tiles.chip_grid(t, 4, 2).withColumn("mean_p", F.lit(0.5)).withColumn("std_p", F.lit(0.1))
    monkeypatch.setattr(tiles, "TASK_SQUARES", 8)
    m = tiles.overlap_mosaic(chips, 4, 2)
    assert m.rdd.getNumPartitions() == 6 * 9 * 4 / 8
    assert m.count() == 6 * 16
    monkeypatch.setattr(rasters, "BLOCK_CELLS", 8)
    px = spark.range(64).selectExpr("id div 8 AS r", "id % 8 AS c", "0 AS band", "CAST(id AS DOUBLE) AS v")
    b = rasters.to_blocks(px, [], "band", 1, 2)
    assert b.rdd.getNumPartitions() == 8
    assert sorted(tuple(r.px) for r in b.collect())[0] == (0.0, 1.0, 8.0, 9.0)


def test_exploded_tiles_are_not_broadcast(spark):
    t = spark.createDataFrame([(1, 8, 8)], "tile_id long, height long, width long")
    m = tiles.overlap_mosaic(tiles.chip_grid(t, 4, 2).withColumn("mean_p", F.lit(0.5)).withColumn("std_p", F.lit(0.1)), 4, 2)
    plan = tiles.with_uncovered(m, t, 2)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_rounds_rank_points_before_they_are_repeated(spark):
    # Against plain sorting, with missing folds and presences; one shuffle of the points instead of one per round.
    data = [(i, i % 3 if i % 3 else None, None if i % 7 == 0 else i % 4 + 1, f"{(i * 37) % 101:032x}") for i in range(100)]
    d = spark.createDataFrame(data, "i long, presence int, fold int, k string").withColumn("g", F.lit("a"))
    got = {(r.i, r.cv_round): r.split for r in splits.cv_rounds(d, ["g"], "k", 3).collect()}
    want = {}
    for r in (1, 2, 3):
        groups = {}
        for i, p, f, k in data:
            groups.setdefault((p, None if f is None else f == r), []).append((k, i))
        for (_, held), members in groups.items():
            n = len(members)
            for rank, (_, i) in enumerate(sorted(members)):
                low = round(n * 0.7)
                want[i, r] = "test" if held else "train" if rank < low else "val"
    assert got == want
    plan = splits.cv_rounds(d, ["g"], "k", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")


def test_designs_hold_a_row_a_point(spark):
    from rangeloom.plans import species

    g = np.random.default_rng(8)
    data = [(str(i), ["a", "b", None][i % 3], int(i % 4 == 0), float(x), float(y)) for i, (x, y) in enumerate(g.uniform(0, 900, (200, 2)))]
    p = spark.createDataFrame([*data, data[7]], "point_id string, species string, presence int, x double, y double").withColumn("point_key", order_key(2, F.col("point_id")))
    d = species.designs(p, 0.70, 0.15, 200.0, 3).localCheckpoint()
    assert d.count() == 201
    got = species.each_round(d)
    u = splits.stratified_split(p, ["species"], "point_key", 0.70, 0.15)
    cv = splits.cv_rounds(d.drop("rounds"), ["species"], "point_key", 3)
    # Of two equal rows either may come first, so they are left out of the comparison by point.
    twice = F.col("point_id") == "7"
    cols = ["point_id", "split"]
    assert rows(got.filter((F.col("cv_round") == 0) & ~twice), *cols) == rows(u.filter(~twice), *cols)
    cols = ["point_id", "cv_round", "split", "fold", "block_id"]
    assert rows(got.filter((F.col("design") == "spatial_cv") & ~twice), *cols) == rows(cv.filter(~twice), *cols)
    assert got.filter("design = 'uniform' AND (fold IS NOT NULL OR cv_round <> 0)").isEmpty() and got.count() == 201 * 4


def test_ranks_shuffle_rows_once(spark):
    d = spark.range(5000).select("id", (F.col("id") % 7).alias("g"), order_key(3, F.col("id")).alias("k"), (F.col("id") % 2 == 0).alias("even"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (ranks.exact_rank(d, ["g"], "k", total="n"), ranks.earlier_counts(d, ["g"], "k", {"even_n": F.col("even")})):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and plan.count("Window [") >= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_projections_of_arrays_equal_those_of_columns(spark):
    g = np.random.default_rng(5)
    zone, north = g.integers(1, 61, 300), g.random(300) < 0.6
    lat, lon = g.uniform(0.1, 80, 300) * np.where(north, 1, -1), zone * 6 - 183 + g.uniform(-4, 4, 300)
    d = spark.createDataFrame([(i, float(a), float(b), int(z), bool(n)) for i, (a, b, z, n) in enumerate(zip(lat, lon, zone, north))], "i int, lat double, lon double, zone int, north boolean")
    d = d.withColumns(dict(zip("xy", geo.albers_xy(F.col("lat"), F.col("lon"))))).withColumns(dict(zip("en", geo.utm_xy(F.col("lat"), F.col("lon"), F.col("zone"), F.col("north")))))
    d = d.withColumns(dict(zip(("lat_a", "lon_a"), geo.albers_inverse(F.col("x"), F.col("y"))))).withColumns(dict(zip(("lat_u", "lon_u"), geo.utm_inverse(F.col("e"), F.col("n"), F.col("zone"), F.col("north")))))
    got = d.orderBy("i").toPandas()
    x, y, e, n = (got[c].to_numpy() for c in ("x", "y", "e", "n"))
    for want, have, most in (
        (("x", "y"), geo_arrays.albers_xy(lat, lon), 1e-7), (("e", "n"), geo_arrays.utm_xy(lat, lon, zone, north), 1e-7),
        (("lat_a", "lon_a"), geo_arrays.albers_inverse(x, y), 1e-12), (("lat_u", "lon_u"), geo_arrays.utm_inverse(e, n, zone, north), 1e-12),
    ):
        assert all(np.abs(got[c].to_numpy() - v).max() < most for c, v in zip(want, have))


WARP_TILES = "tile_id long, height long, width long, x0 double, y0 double, px_size double, zone int, north boolean"
WARP_SQUARES = "tile_id long, cell_row long, cell_col long, prediction double, uncertainty double"


def warp_by_hand(tile_rows, squares, cell, res):
    """Weight sums pixel by pixel; of squares at one place the greater counts."""
    of, out = {}, {}
    for s in sorted(squares, key=lambda s: [(v is not None, v or 0) for v in s]):
        of[s[:3]] = s[3:]
    for k, h, w, x0, y0, px, zone, north in set(tile_rows):
        if None in (k, h, w, x0, y0, px, zone):
            continue
        north = north is not False
        at = [geo_arrays.albers_xy(*geo_arrays.utm_inverse(x0 + c * px, y0 - r * px, zone, north)) for r in (0, h) for c in (0, w)]
        (x1, x2), (y1, y2) = ((math.floor(min(v) / res), math.floor(max(v) / res)) for v in zip(*at))
        for gy in range(y1, y2 + 1):
            for gx in range(x1, x2 + 1):
                x, y = geo_arrays.utm_xy(*geo_arrays.albers_inverse((gx + 0.5) * res, (gy + 0.5) * res), zone, north)
                u, v = (float(x) - x0) / px - 0.5, (y0 - float(y)) / px - 0.5
                for r, c in ((math.floor(v) + a, math.floor(u) + b) for a in (0, 1) for b in (0, 1)):
                    weight, s = (1 - abs(u - c)) * (1 - abs(v - r)), of.get((k, r // cell, c // cell))
                    if 0 <= r < h and 0 <= c < w and s and weight > 0:
                        terms = out.setdefault((k, gx, gy), [])
                        terms.append((weight, *s))
    mean = lambda t, i: None if all(x[i] is None for x in t) else sum(x[0] * x[i] for x in t if x[i] is not None) / sum(x[0] for x in t)
    return {at: (mean(t, 1), mean(t, 2)) for at, t in out.items()}


def odd_warp():
    north, south = (300000.0, 4100000.0, 1.0, 11, True), (500000.0, 6000000.0, 0.6, 19, False)
    t = [(1, 640, 500, *north), (1, 640, 500, *north), (2, 300, 700, *south), (3, 256, 256, *north), (3, 300, 256, 300050.0, 4100040.0, 1.0, 11, None), (4, None, 300, *north),
         (5, 300, 300, None, *north[1:]), (None, 300, 300, *north), (6, 300, 300, *north), (7, 300, 300, *north[:3], None, True), (8, 512, 512, 700000.0, 1000.0, 5.0, 32, True)]
    g = np.random.default_rng(3)
    some = lambda share: float(g.random()) if g.random() < share else None
    m = [(k, r, c, some(0.8), some(0.9)) for k in (1, 2, 3, 4, 5, 7, 8, 9, None) for r in range(-1, 11) for c in range(-1, 12) if g.random() < 0.8]
    # Squares at one place, without a place, and with a number that is none.
    return t, [*m, (1, 0, 0, 0.9, 0.1), (1, 0, 0, 0.2, 0.7), (1, None, 0, 0.2, 0.7)], [(3, 1, 1, float("nan"), 0.5)]


def test_warp_equals_sums_by_hand(spark, monkeypatch):
    t, m, nan = odd_warp()
    m = [s for s in m if s[:3] != (3, 1, 1)]
    want = warp_by_hand(t, [s for s in m if None not in s[:3]] + nan, 64, 20.0)
    assert {k for k, _, _ in want} == {1, 2, 3, 8} and any(a is None for a, _ in want.values())
    assert any(a is not None and math.isnan(a) for a, _ in want.values())
    td, md = spark.createDataFrame(t, WARP_TILES), spark.createDataFrame(m + nan, WARP_SQUARES)
    for part, rows_at_once in ((tiles.PART_TARGETS, tiles.WARP_ROWS), (100, 7)):
        # Then tiles are cut into parts, and tables end at every tile.
        monkeypatch.setattr(tiles, "PART_TARGETS", part)
        monkeypatch.setattr(tiles, "WARP_ROWS", rows_at_once)
        out = tiles.mosaic_reproject(md, td, 64, 20.0).collect()
        got = {(r.tile_id, r.gx, r.gy): (r.prediction, r.uncertainty) for r in out}
        assert len(out) == len(got) and set(got) == set(want)
        for k, pair in want.items():
            assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-7 or math.isnan(a) and math.isnan(b)) for a, b in zip(got[k], pair)), k


def test_warp_makes_targets_a_batch_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    t, m, _ = odd_warp()
    info = pa.struct([(n, k) for n, k in zip(("height", "width", "x0", "y0", "px_size", "zone", "north"), (pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.bool_()))])
    rows_in = [{"tile_id": 1, "_tile": dict(zip([f.name for f in info], t[0][1:])), "cell_row": None, "cell_col": None, "prediction": None, "uncertainty": None}]
    rows_in += [dict(zip(("tile_id", "cell_row", "cell_col", "prediction", "uncertainty"), s)) | {"_tile": None} for s in m if s[0] == 1 and s[1] is not None]
    kinds = [("tile_id", pa.int64()), ("_tile", info), ("cell_row", pa.int64()), ("cell_col", pa.int64()), ("prediction", pa.float64()), ("uncertainty", pa.float64()), ("_part", pa.int32()), ("_parts", pa.int32())]
    table = pa.Table.from_pylist([r | {"_part": 0, "_parts": 1} for r in rows_in], pa.schema(kinds))
    whole = pa.Table.from_batches(warp.warp_table(table, 64, 20.0))
    monkeypatch.setattr(warp, "TARGETS", 100)
    batches = [*warp.warp_table(table, 64, 20.0)]
    assert max(b.num_rows for b in batches) <= 100 and len(batches) > 5 and pa.Table.from_batches(batches).equals(whole)


def test_warp_stores_and_shuffles_no_target_pixels(spark, monkeypatch):
    t = spark.createDataFrame([(k, 640, 500, 300000.0 + k, 4100000.0, 1.0, 11) for k in range(5)], "tile_id long, height long, width long, x0 double, y0 double, px_size double, zone int")
    m = tiles.overlap_mosaic(tiles.chip_grid(t, 256, 128).withColumns({"mean_p": F.lit(0.5), "std_p": F.lit(0.1)}), 256, 128)
    stored = []
    monkeypatch.setattr(tiles, "materialize", lambda d, name="": stored.append(d.count()) or d)
    out = tiles.mosaic_reproject(m, t, 128, 20.0)
    assert out.count() > 1000 and stored == [5]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The one shuffle before the pixels is that of squares and tiles, by tile.
    assert "SortMergeJoin" not in plan and "gy" not in plan[plan.index("MapInArrow") :].split("\n", 1)[1]
