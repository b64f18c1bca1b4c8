"""Trial analytics over the derived log (W*, L1-L3, L5, A15-A17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import trials as t
from ..registry import Inputs, query
from .common import rnd

_TS = "try_strptime(substr(run_id, 1, 15), '%Y%m%d_%H%M%S')"
_NUM = f"""WITH num AS (SELECT *, {_TS} AS run_time, row_number() OVER (PARTITION BY benchmark_name ORDER BY {_TS} NULLS LAST, run_id) AS trial FROM trials)
"""


@query(
    "W1_best_so_far", ["trials"],
    _NUM + """, b AS (SELECT *, CASE WHEN mean_val_mcc IS NOT NULL THEN max(mean_val_mcc) OVER (PARTITION BY benchmark_name ORDER BY trial) END AS best FROM num)
 SELECT run_id, benchmark_name, trial, round(best, 6) AS best_so_far_mcc, coalesce(mean_val_mcc = best, false) AS is_new_best,
 coalesce(mean_val_mcc = best, false) AND count(*) OVER (PARTITION BY benchmark_name, best) > 1 AS is_repeat_best FROM b""",
)
def best_so_far(i: Inputs):
    d = t.best_so_far(i.trials)
    return d.select("run_id", "benchmark_name", "trial", rnd("best_so_far_mcc"), "is_new_best", "is_repeat_best")


@query("W2_trial_no", ["trials"], _NUM + "SELECT run_id, benchmark_name, trial, CAST(epoch(run_time) AS BIGINT) AS started FROM num")
def trial_no(i: Inputs):
    return t.numbered(i.trials).select("run_id", "benchmark_name", "trial", F.unix_timestamp("run_time").alias("started"))


def _setting_sql(k: str) -> str:
    v = f"json_extract_string(search_space_json, '$.{k}')"
    return f"{v} AS {k}"


def _text_sql(v: str) -> str:
    x = f"try_cast({v} AS DOUBLE)"
    return (
        f"CASE WHEN {v} IS NULL THEN 'None' WHEN {x} IS NULL THEN {v} WHEN {x} <> 0 AND (abs({x}) < 0.001 OR abs({x}) >= 10000)"
        f" THEN format('{{:.2g}}', {x}) ELSE format('{{:g}}', {x}) END"
    )


def _diff_sql(now: str, then: str) -> str:
    parts = []
    for k in ("model_type", "optimizer", "learning_rate", "batch_size", "seed", "dropout", "lr_patience"):
        a, b = f"{now}.{k}", f"{then}.{k}"
        same = f"CASE WHEN try_cast({a} AS DOUBLE) IS NOT NULL AND try_cast({b} AS DOUBLE) IS NOT NULL THEN abs(try_cast({a} AS DOUBLE) - try_cast({b} AS DOUBLE)) <= 1e-12 ELSE {a} IS NOT DISTINCT FROM {b} END"
        parts.append(f"CASE WHEN {a} IS NOT NULL AND NOT ({same}) THEN concat('{k}: ', {_text_sql(b)}, ' -> ', {_text_sql(a)}) END")
    return f"coalesce(nullif(concat_ws('; ', {', '.join(parts)}), ''), 'baseline / repeat')"


_SET = (
    _NUM
    + ", s AS (SELECT run_id, benchmark_name, trial, mean_val_mcc, "
    + ", ".join(_setting_sql(k) for k in ("model_type", "optimizer", "learning_rate", "batch_size", "seed", "dropout", "lr_patience"))
    + " FROM num), top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY benchmark_name ORDER BY mean_val_mcc DESC NULLS LAST, trial) = 1)\n"
)


@query(
    "W3_changes_vs_previous", ["trials"],
    _SET + f"SELECT s.run_id, s.trial, {_diff_sql('s', 'q')} AS changes_vs_previous FROM s JOIN s q ON q.benchmark_name = s.benchmark_name AND q.trial = greatest(s.trial - 1, 1)",
)
def changes_vs_previous(i: Inputs):
    return t.enriched(i.trials).select("run_id", "trial", "changes_vs_previous")


@query(
    "W4_changes_vs_baseline_best", ["trials"],
    _SET + f"""SELECT s.run_id, {_diff_sql('s', 'b')} AS changes_vs_baseline, {_diff_sql('s', 'p')} AS changes_vs_best
 FROM s JOIN s b ON b.benchmark_name = s.benchmark_name AND b.trial = 1 JOIN top p ON p.benchmark_name = s.benchmark_name""",
)
def changes_vs_ends(i: Inputs):
    return t.enriched(i.trials).select("run_id", "changes_vs_baseline", "changes_vs_best")


_RATCHET = "mean_val_mcc DESC NULLS LAST, mean_val_auc DESC NULLS LAST, mean_val_sensitivity DESC NULLS LAST, mean_val_specificity DESC NULLS LAST, mean_val_loss ASC NULLS LAST, run_id"


@query("W5_ratchet_rank", ["trials"], f"SELECT run_id, benchmark_name, row_number() OVER (PARTITION BY benchmark_name ORDER BY {_RATCHET}) AS ratchet_rank FROM trials")
def ratchet_rank(i: Inputs):
    return t.ratchet_rank(i.trials).select("run_id", "benchmark_name", "ratchet_rank")


@query(
    "W_config_summary", ["trials"],
    _SET + f"""SELECT run_id, concat(model_type, ', opt=', optimizer, ', lr=', {_text_sql('learning_rate')}, ', wd=nan, drop=', {_text_sql('dropout')},
 ', pat=', {_text_sql('lr_patience')}, ', seed=', {_text_sql('seed')}) AS config_summary FROM s""",
)
def config_summary(i: Inputs):
    return t.with_settings(i.trials).select("run_id", t.one_line(F.col("settings")).alias("config_summary"))


@query("L1_top_runs", ["trials"], f"SELECT run_id, mean_val_mcc, mean_val_auc, mean_val_loss FROM trials ORDER BY {_RATCHET} LIMIT 20")
def top_runs(i: Inputs):
    return t.top_runs(i.trials).select("run_id", "mean_val_mcc", "mean_val_auc", "mean_val_loss")


@query("L2_top_by_mcc", ["trials"], "SELECT run_id, mean_val_mcc FROM trials ORDER BY mean_val_mcc DESC NULLS LAST, run_id LIMIT 15")
def top_by_mcc(i: Inputs):
    return t.top_by_mcc(i.trials).select("run_id", "mean_val_mcc")


_FAMILY = """SELECT model_type, count(*) AS n, max(mean_val_mcc) AS best_mcc, round(median(mean_val_mcc), 6) AS median_mcc, max(mean_val_auc) AS best_auc, min(mean_val_loss) AS best_loss
 FROM trials GROUP BY model_type"""


@query("A15_family_summary", ["trials"], _FAMILY)
def family_summary(i: Inputs):
    return t.family_summary(i.trials).select("model_type", "n", "best_mcc", rnd("median_mcc"), "best_auc", "best_loss")


@query("L3_family_order", ["trials"], "SELECT model_type, row_number() OVER (ORDER BY max(mean_val_mcc) DESC NULLS LAST, model_type) AS place FROM trials GROUP BY model_type")
def family_order(i: Inputs):
    # One row per family, of which there are seven.
    f = t.family_summary(i.trials).select("model_type", "best_mcc")
    place = F.struct(F.coalesce(-F.col("best_mcc"), F.lit(2.0)).alias("k"), "model_type")
    all_places = f.agg(F.array_sort(F.collect_list(place)).alias("a"))
    return all_places.select(F.posexplode("a").alias("p", "r")).select("r.model_type", (F.col("p") + 1).cast("long").alias("place"))


@query(
    "A16_hyperparam_slices", ["trials"],
    _SET + """, f AS (SELECT * FROM s WHERE model_type = 'image_topo_tabular'),
 u AS (SELECT 'learning_rate' AS setting, CAST(learning_rate AS DOUBLE) AS value, mean_val_mcc FROM f UNION ALL SELECT 'dropout', CAST(dropout AS DOUBLE), mean_val_mcc FROM f
  UNION ALL SELECT 'lr_patience', CAST(lr_patience AS DOUBLE), mean_val_mcc FROM f UNION ALL SELECT 'seed', CAST(seed AS DOUBLE), mean_val_mcc FROM f)
 SELECT setting, value, max(mean_val_mcc) AS best_mcc FROM u WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def hyperparam_slices(i: Inputs):
    return t.hyperparam_slices(t.with_settings(i.trials))


@query(
    "A17_family_box", ["trials"],
    """SELECT model_type, round(quantile_cont(mean_val_mcc, 0.0), 6) AS low, round(quantile_cont(mean_val_mcc, 0.25), 6) AS q1, round(quantile_cont(mean_val_mcc, 0.5), 6) AS median,
 round(quantile_cont(mean_val_mcc, 0.75), 6) AS q3, round(quantile_cont(mean_val_mcc, 1.0), 6) AS high FROM trials GROUP BY model_type""",
)
def family_box(i: Inputs):
    return t.family_box(i.trials).select("model_type", *[rnd(c) for c in ("low", "q1", "median", "q3", "high")])


@query(
    "L5_seed_runs", ["trials"],
    _SET + "SELECT s.run_id, s.seed FROM s JOIN top p USING (benchmark_name) WHERE s.seed = '42' OR s.seed <> p.seed",
)
def seed_runs(i: Inputs):
    return t.seed_runs(t.enriched(i.trials)).select("run_id", F.col("settings.seed").alias("seed"))
