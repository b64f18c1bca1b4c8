"""Derived input views, written once in SQL that Spark and DuckDB both accept.

`{name}` refers to a given table or to another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {
    # Dirty occurrence text: blanks, out-of-range values, words, missing source and uncertainty.
    "occ_raw": """
SELECT event_id AS occ_id, event_type AS species,
  CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 89 = 0 THEN '95.5' WHEN event_id % 83 = 0 THEN 'n.d.'
       ELSE concat(CAST(30 + (user_id*7919) % 15 AS STRING), '.', CAST(100 + (event_id*31) % 900 AS STRING)) END AS lat_text,
  CASE WHEN event_id % 101 = 0 THEN '-190' ELSE concat('-', CAST(75 + (user_id*15485863) % 45 AS STRING), '.', CAST(100 + (event_id*17) % 900 AS STRING)) END AS lon_text,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('src', CAST(event_id % 3 AS STRING)) END AS source_raw,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'unknown' ELSE CAST((event_id*31) % 2000 AS STRING) END AS uncertainty_text
FROM {events}""",
    # Clean points with labels and projected metres left to the operators.
    "occ": """
SELECT event_id AS occ_id, event_type AS species, user_id,
  30 + CAST((user_id*7919) % 15000 AS DOUBLE)/1000 + CAST((event_id*104729) % 2001 - 1000 AS DOUBLE)/20000 AS lat,
  -120 + CAST((user_id*15485863) % 45000 AS DOUBLE)/1000 + CAST((event_id*1299709) % 2001 - 1000 AS DOUBLE)/20000 AS lon,
  CASE WHEN event_type IN ('purchase','signup') THEN 1 ELSE 0 END AS presence,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((event_id*31) % 2000 AS DOUBLE) END AS coordinate_uncertainty_m,
  concat('src', CAST(event_id % 3 AS STRING)) AS source,
  md5(concat(42, ':', event_id)) AS order_key
FROM {events}""",
    # Half-degree tiles wherever a presence lies, widened by 1/64 degree so neighbours overlap.
    "tile_idx": """
SELECT tr * 1000 + tc AS tile_id, concat('dir/M_', CAST(tr * 1000 + tc AS STRING), '.TIF') AS filename,
  concat('u/', CAST(tr * 1000 + tc AS STRING)) AS url,
  CAST(tc - 361 AS DOUBLE)/2 AS minx, CAST(tr - 181 AS DOUBLE)/2 AS miny,
  CAST(tc - 361 AS DOUBLE)/2 + CAST(33 AS DOUBLE)/64 AS maxx, CAST(tr - 181 AS DOUBLE)/2 + CAST(33 AS DOUBLE)/64 AS maxy,
  (tr * 1000 + tc) % 7 <> 3 AS downloaded
FROM (SELECT DISTINCT CAST(floor(lat * 2) AS BIGINT) + 181 AS tr, CAST(floor(lon * 2) AS BIGINT) + 361 AS tc
      FROM {occ} WHERE presence = 1) s""",
    # 20 layers on a 1/8 degree grid (origin 50 N, 130 W) over every cell that holds an event; NULL is nodata.
    "env_cell": """
SELECT r, c, count(*) AS n
FROM (SELECT CAST(floor((50 - lat) * 8) AS BIGINT) AS r, CAST(floor((lon + 130) * 8) AS BIGINT) AS c FROM {occ}) s
GROUP BY r, c""",
    "env_pixel": """
SELECT CAST(layer AS BIGINT) AS layer, r, c, CASE WHEN (r + c + layer) % 53 = 0 THEN NULL
  ELSE CAST((r*31 + c*17 + layer*101 + n*7) % 1009 AS DOUBLE)/8 END AS v
FROM (SELECT r, c, n, @each(0, 19) AS layer FROM {env_cell}) s""",
    # Scores with heavy ties.
    "pred": """
SELECT event_id AS sample_id, user_id % 5 AS eval_set,
  CASE WHEN event_type IN ('purchase','signup') THEN 1 ELSE 0 END AS true_label,
  CAST((event_id*7919) % 1000 + CASE WHEN event_type IN ('purchase','signup') THEN 300 ELSE 0 END AS DOUBLE)/1299 AS probability
FROM {events}""",
    "pred_class": """
SELECT sample_id, eval_set, true_label, probability, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS predicted_label
FROM {pred}""",
    # Training epochs per run.
    "history": """
SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS epoch,
  CAST((event_id*613) % 997 AS DOUBLE)/1000 AS val_loss, CAST((event_id*389) % 991 AS DOUBLE)/1000 AS val_mcc,
  CAST((event_id*211) % 983 AS DOUBLE)/1000 AS val_auc
FROM {events}""",
    # Trial log with ties, missing metrics and a malformed run id.
    "trials": """
SELECT s_suppkey AS trial_seq, concat('bench', CAST(s_suppkey % 2 AS STRING)) AS benchmark_name,
  CASE WHEN s_suppkey % 31 = 7 THEN concat('bad_run_id_', CAST(s_suppkey AS STRING))
       ELSE concat('20260512_', lpad(CAST(CAST(floor(s_suppkey/3600) AS BIGINT) % 24 AS STRING), 2, '0'), lpad(CAST(CAST(floor(s_suppkey/60) AS BIGINT) % 60 AS STRING), 2, '0'), lpad(CAST(s_suppkey % 60 AS STRING), 2, '0'), '_x') END AS run_id,
  concat('runs/', CAST(s_suppkey % 2 AS STRING), '/r', CAST(s_suppkey AS STRING)) AS run_dir,
  CASE s_suppkey % 3 WHEN 0 THEN 'image_topo_tabular' WHEN 1 THEN 'tabular_only' ELSE 'topo_tabular' END AS model_type,
  CASE WHEN s_suppkey % 23 = 5 THEN NULL ELSE CAST((s_suppkey*37) % 50 AS DOUBLE)/50 END AS mean_val_mcc,
  CAST((s_suppkey*53) % 97 AS DOUBLE)/97 AS mean_val_auc, CAST((s_suppkey*29) % 89 AS DOUBLE)/89 AS mean_val_loss,
  CAST((s_suppkey*41) % 83 AS DOUBLE)/83 AS mean_val_sensitivity, CAST((s_suppkey*43) % 79 AS DOUBLE)/79 AS mean_val_specificity,
  concat('{{"model_type": "', CASE s_suppkey % 3 WHEN 0 THEN 'image_topo_tabular' WHEN 1 THEN 'tabular_only' ELSE 'topo_tabular' END,
         '", "learning_rate": ', CASE s_suppkey % 4 WHEN 0 THEN '0.0001' WHEN 1 THEN '0.00015' WHEN 2 THEN '5e-05' ELSE '0.0003' END,
         ', "dropout": ', CASE s_suppkey % 2 WHEN 0 THEN '0.45' ELSE '0.25' END,
         ', "optimizer": "', CASE s_suppkey % 7 WHEN 0 THEN 'sgd' ELSE 'adamw' END,
         '", "batch_size": ', CASE s_suppkey % 11 WHEN 0 THEN '20000' ELSE '16' END,
         ', "lr_patience": ', CASE s_suppkey % 6 WHEN 0 THEN '3' ELSE '2' END,
         ', "seed": ', CASE s_suppkey % 5 WHEN 0 THEN '7' ELSE '42' END, '}}') AS search_space_json
FROM {supplier}""",
    # Tile sizes; some smaller than one chip.
    "tile_dims": """
SELECT p_partkey AS tile_id, CAST(192 + 64 * (p_size % 9) AS BIGINT) AS height, CAST(192 + 64 * ((p_size*7) % 11) AS BIGINT) AS width FROM {part}""",
    # Four stochastic passes per chip.
    "mc_pass": """
SELECT sample_id, eval_set, pass, probability * (8 + pass) / 16 AS probability
FROM (SELECT sample_id, eval_set, probability, @each(0, 3) AS pass FROM {pred}) s""",
    # Embeddings read as 4 bands of 4 x 4 pixels, row-major; every 29th entry is missing.
    "chip_pixel": """
SELECT vec_id, CAST(floor(i / 16) AS BIGINT) AS band, CAST(floor((i % 16) / 4) AS BIGINT) AS y, CAST(i % 4 AS BIGINT) AS x, i,
  CASE WHEN (vec_id + i) % 29 = 0 THEN NULL ELSE floor(abs(CAST(e AS DOUBLE)) * 1000) END AS v
FROM (SELECT vec_id, @each_pos(embedding, e, i) FROM {embeddings}) s""",
    # Overlapping image tiles of 20 x 20 pixels (25 embeddings each), 16 map units apart; two CRSs.
    "img_tile": """
SELECT tile_id, CASE WHEN tile_id % 6 = 5 THEN 'EPSG:26912' ELSE 'EPSG:26911' END AS crs, CAST(tile_id * 16 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0,
  CAST(1 AS DOUBLE) AS px_size, 20 AS h, 20 AS w, CAST(tile_id * 16 AS DOUBLE) AS minx, CAST(-20 AS DOUBLE) AS miny, CAST(tile_id * 16 + 20 AS DOUBLE) AS maxx, CAST(0 AS DOUBLE) AS maxy
FROM (SELECT DISTINCT CAST(floor(vec_id / 25) AS BIGINT) AS tile_id FROM {embeddings}) s""",
    "img_pixel": """
SELECT CAST(floor(vec_id / 25) AS BIGINT) AS tile_id, band, CAST(floor((vec_id % 25) / 5) AS BIGINT) * 4 + y AS r, ((vec_id % 25) % 5) * 4 + x AS c, coalesce(v, 0) AS v
FROM {chip_pixel}""",
    # One terrain raster: 0.8 x 1 map units per pixel, 4 bands, with missing pixels.
    "topo_pixel": """
SELECT band, CAST(floor((vec_id % 25) / 5) AS BIGINT) * 4 + y AS r, CAST(floor(vec_id / 25) AS BIGINT) * 20 + ((vec_id % 25) % 5) * 4 + x AS c, v
FROM {chip_pixel}""",
    "site": """
SELECT vec_id AS sample_id, CAST(CAST(floor(vec_id / 25) AS BIGINT) * 16 + ((vec_id % 25) % 5) * 4 + vec_id % 3 AS DOUBLE) + 1.5 AS x,
  -(CAST(CAST(floor((vec_id % 25) / 5) AS BIGINT) * 4 + vec_id % 2 AS DOUBLE) + 1.5) AS y
FROM {embeddings}""",
    # Outlines of the image tiles: an octagon within the box and, in two tiles of three, a diamond-shaped hole.
    "tile_edge": """
SELECT tile_id, k, minx + (maxx - minx) * ax AS ax, miny + (maxy - miny) * ay AS ay, minx + (maxx - minx) * bx AS bx, miny + (maxy - miny) * byy AS byy
FROM {tile_idx}, (VALUES (0, 0.25e0, 0.0e0, 0.75e0, 0.0e0), (1, 0.75e0, 0.0e0, 1.0e0, 0.25e0), (2, 1.0e0, 0.25e0, 1.0e0, 0.75e0), (3, 1.0e0, 0.75e0, 0.75e0, 1.0e0),
 (4, 0.75e0, 1.0e0, 0.25e0, 1.0e0), (5, 0.25e0, 1.0e0, 0.0e0, 0.75e0), (6, 0.0e0, 0.75e0, 0.0e0, 0.25e0), (7, 0.0e0, 0.25e0, 0.25e0, 0.0e0),
 (8, 0.5e0, 0.25e0, 0.75e0, 0.5e0), (9, 0.75e0, 0.5e0, 0.5e0, 0.75e0), (10, 0.5e0, 0.75e0, 0.25e0, 0.5e0), (11, 0.25e0, 0.5e0, 0.5e0, 0.25e0)) AS v(k, ax, ay, bx, byy)
WHERE k < 8 OR tile_id % 3 <> 0""",
    # UTM tiles for inference: origin and zone per tile.
    "utm_tile": """
SELECT tile_id, height, width, 300000 + CAST((tile_id % 50) * 1000 AS DOUBLE) AS x0, 4100000 - CAST((tile_id % 37) * 1000 AS DOUBLE) AS y0, CAST(1 AS DOUBLE) AS px_size, 11 AS zone
FROM {tile_dims}""",
}


def needs(name: str) -> list[str]:
    """Tables and views a view reads directly."""
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", VIEWS[name])))


def _dialect(sql: str, engine: str) -> str:
    """Row-generating selections, the only part the two engines spell differently."""
    if engine == "spark":
        sql = re.sub(r"@each\((\d+), (\d+)\)", r"explode(sequence(\1, \2))", sql)
        return re.sub(r"@each_pos\((\w+), (\w+), (\w+)\)", r"posexplode(\1) AS (\3, \2)", sql)
    sql = re.sub(r"@each\((\d+), (\d+)\)", r"unnest(generate_series(\1, \2))", sql)
    return re.sub(r"@each_pos\((\w+), (\w+), (\w+)\)", r"unnest(\1) AS \2, generate_subscripts(\1, 1) - 1 AS \3", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_dialect(VIEWS[name], "spark"), **{d: view(spark, sf_dir, d) for d in needs(name)})


def _order(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n in VIEWS and n not in seen:
            _order(needs(n), seen)
            seen.append(n)
    return seen


def with_views(names: list[str], query: str) -> str:
    """`query` for DuckDB with the views it reads as leading CTEs."""
    ctes = []
    for n in _order(names, []):
        refs = {d: d for d in needs(n)}
        ctes.append(f"{n} AS ({_dialect(VIEWS[n], "duck").format(**refs)})")
    q = query.strip()
    if not ctes:
        return q
    if q[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + q[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + q
