"""Metrics over the derived predictions and histories (A*, M4-M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import clean, metrics, splits
from ..registry import Inputs, query
from .common import rnd

BY = ["eval_set"]


@query(
    "A1_confusion", ["pred_class"],
    """SELECT eval_set, count(*) FILTER (true_label = 0 AND predicted_label = 0) AS tn, count(*) FILTER (true_label = 0 AND predicted_label = 1) AS fp,
 count(*) FILTER (true_label = 1 AND predicted_label = 0) AS fn, count(*) FILTER (true_label = 1 AND predicted_label = 1) AS tp FROM pred_class GROUP BY eval_set""",
)
def confusion(i: Inputs):
    return metrics.confusion(i.pred_class, BY)


@query(
    "A2_error_type", ["pred_class"],
    """SELECT eval_set, CASE WHEN true_label = 1 THEN CASE WHEN predicted_label = 1 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN predicted_label = 1 THEN 'FP' ELSE 'TN' END END AS error_type,
 count(*) AS n FROM pred_class GROUP BY 1, 2""",
)
def error_type(i: Inputs):
    d = i.pred_class.withColumn("error_type", metrics.error_type(F.col("true_label"), F.col("predicted_label")))
    return d.groupBy("eval_set", "error_type").agg(F.count(F.lit(1)).alias("n"))


_CM = """WITH c AS (SELECT eval_set, count(*) AS n, CAST(sum(true_label) AS DOUBLE) AS p, CAST(sum(1 - true_label) AS DOUBLE) AS g,
 CAST(sum(true_label * predicted_label) AS DOUBLE) AS tp, CAST(sum((1 - true_label) * predicted_label) AS DOUBLE) AS fp,
 avg(power(probability - true_label, 2)) AS brier, avg(probability) AS mp, avg(probability) FILTER (true_label = 1) AS mpp, avg(probability) FILTER (true_label = 0) AS mpn
 FROM pred_class GROUP BY eval_set)
"""


@query(
    "A3_threshold_metrics", ["pred_class"],
    _CM + """SELECT eval_set, n AS n_samples, CAST(p AS BIGINT) AS n_positive, CAST(g AS BIGINT) AS n_negative, round((tp + g - fp) / n, 6) AS accuracy,
 round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN p = 0 THEN 0 ELSE tp / p END, 6) AS recall,
 round(CASE WHEN tp + fp + p = 0 THEN 0 ELSE 2 * tp / (tp + fp + p) END, 6) AS f1 FROM c""",
)
def threshold_metrics(i: Inputs):
    s = metrics.summary(i.pred_class, BY)
    return s.select("eval_set", "n_samples", "n_positive", "n_negative", *[rnd(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("A4_sens_spec", ["pred_class"], _CM + "SELECT eval_set, round(tp / nullif(p, 0), 6) AS sensitivity, round((g - fp) / nullif(g, 0), 6) AS specificity FROM c")
def sens_spec(i: Inputs):
    return metrics.summary(i.pred_class, BY).select("eval_set", rnd("sensitivity"), rnd("specificity"))


@query(
    "A5_mcc", ["pred_class"],
    _CM + """SELECT eval_set, round(CASE WHEN p = 0 OR g = 0 THEN NULL WHEN tp + fp = 0 OR n - tp - fp = 0 THEN 0
 ELSE (tp * (g - fp) - fp * (p - tp)) / sqrt((tp + fp) * p * g * (n - tp - fp)) END, 6) AS mcc FROM c""",
)
def mcc(i: Inputs):
    return metrics.summary(i.pred_class, BY).select("eval_set", rnd("mcc"))


@query("A6_balanced_accuracy", ["pred_class"], _CM + "SELECT eval_set, round(CASE WHEN p > 0 AND g > 0 THEN (tp / p + (g - fp) / g) / 2 END, 6) AS balanced_accuracy FROM c")
def balanced_accuracy(i: Inputs):
    return metrics.summary(i.pred_class, BY).select("eval_set", rnd("balanced_accuracy"))


@query("A7_brier", ["pred_class"], _CM + "SELECT eval_set, round(CASE WHEN p > 0 AND g > 0 THEN brier END, 6) AS brier FROM c")
def brier(i: Inputs):
    return metrics.summary(i.pred_class, BY).select("eval_set", rnd("brier"))


@query("A8_mean_prob", ["pred_class"], _CM + "SELECT eval_set, round(mp, 6) AS mean_probability, round(mpp, 6) AS mean_probability_positive, round(mpn, 6) AS mean_probability_negative FROM c")
def mean_prob(i: Inputs):
    s = metrics.summary(i.pred_class, BY)
    return s.select("eval_set", *[rnd(c) for c in ("mean_probability", "mean_probability_positive", "mean_probability_negative")])


@query(
    "A9_class_report", ["pred_class"],
    _CM + """, k AS (SELECT eval_set, 'Background' AS label, (g - fp) AS hit, (g - fp) + (p - tp) AS named, g AS support, n FROM c
 UNION ALL SELECT eval_set, 'Presence', tp, tp + fp, p, n FROM c),
 m AS (SELECT eval_set, label, CASE WHEN named = 0 THEN 0 ELSE hit / named END AS pr, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS re,
   CASE WHEN named + support = 0 THEN 0 ELSE 2 * hit / (named + support) END AS f, support, n FROM k)
 SELECT eval_set, label, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1_score, round(support, 6) AS support FROM m
 UNION ALL SELECT eval_set, 'accuracy', round(sum(re * support) / max(n), 6), round(sum(re * support) / max(n), 6), round(sum(re * support) / max(n), 6), round(sum(re * support) / max(n), 6) FROM m GROUP BY eval_set
 UNION ALL SELECT eval_set, 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), CAST(max(n) AS DOUBLE) FROM m GROUP BY eval_set
 UNION ALL SELECT eval_set, 'weighted avg', round(sum(pr * support) / max(n), 6), round(sum(re * support) / max(n), 6), round(sum(f * support) / max(n), 6), CAST(max(n) AS DOUBLE) FROM m GROUP BY eval_set""",
)
def class_report(i: Inputs):
    r = metrics.class_report(i.pred_class, BY)
    return r.select("eval_set", "label", *[rnd(c) for c in ("precision", "recall", "f1_score", "support")])


_PTS = """WITH g AS (SELECT eval_set, probability, CAST(sum(true_label) AS BIGINT) AS pos, CAST(sum(1 - true_label) AS BIGINT) AS neg FROM pred_class GROUP BY 1, 2),
 k AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, sum(pos) OVER (PARTITION BY eval_set) AS p, sum(neg) OVER (PARTITION BY eval_set) AS n
   FROM g WINDOW w AS (PARTITION BY eval_set ORDER BY probability DESC))
"""


@query(
    "A10_roc_curve", ["pred_class"],
    _PTS + """, d AS (SELECT *, lag(pos) OVER w AS has_prev, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM k WINDOW w AS (PARTITION BY eval_set ORDER BY probability DESC))
 SELECT eval_set, round(probability, 6) AS threshold, round(fps / n, 6) AS fpr, round(tps / p, 6) AS tpr FROM d
 WHERE has_prev IS NULL OR np IS NULL OR pos <> np OR neg <> nn
 UNION ALL SELECT DISTINCT eval_set, CAST('inf' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM k""",
)
def roc_curve(i: Inputs):
    r = metrics.roc_curve(i.pred_class, BY)
    inf = F.col("threshold") == float("inf")
    return r.select("eval_set", F.when(inf, F.col("threshold")).otherwise(F.round("threshold", 6)).alias("threshold"), rnd("fpr"), rnd("tpr"))


@query("A11_roc_auc", ["pred_class"], _PTS + "SELECT eval_set, round(sum(neg * (tps - pos + pos / 2.0)) / (max(p) * max(n)), 6) AS roc_auc FROM k GROUP BY eval_set")
def roc_auc(i: Inputs):
    return metrics.roc_auc(i.pred_class, BY).select("eval_set", rnd("roc_auc"))


@query(
    "A12_pr_curve", ["pred_class"],
    _PTS + """SELECT eval_set, round(probability, 6) AS threshold, round(tps / (tps + fps), 6) AS "precision", round(tps / p, 6) AS recall FROM k
 UNION ALL SELECT DISTINCT eval_set, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM k""",
)
def pr_curve(i: Inputs):
    return metrics.pr_curve(i.pred_class, BY).select("eval_set", rnd("threshold"), rnd("precision"), rnd("recall"))


@query("A13_average_precision", ["pred_class"], _PTS + "SELECT eval_set, round(sum(pos / p * tps / (tps + fps)), 6) AS average_precision FROM k GROUP BY eval_set")
def average_precision(i: Inputs):
    return metrics.average_precision(i.pred_class, BY).select("eval_set", rnd("average_precision"))


@query(
    "A14_fold_nanmean", ["history"],
    """SELECT CAST(epoch AS INTEGER) AS epoch, round(avg(val_loss), 6) AS mean_val_loss, round(avg(CASE WHEN run_id % 7 <> 3 THEN val_mcc END), 6) AS mean_val_mcc FROM history GROUP BY epoch""",
)
def fold_nanmean(i: Inputs):
    d = i.history.withColumn("val_mcc", F.when(F.col("run_id") % 7 == 3, float("nan")).otherwise(F.col("val_mcc")))
    return metrics.fold_nanmean(d, ["epoch"], ["val_loss", "val_mcc"]).select("epoch", rnd("mean_val_loss"), rnd("mean_val_mcc"))


@query(
    "A_summary", ["pred_class"],
    _PTS + """, a AS (SELECT eval_set, sum(neg * (tps - pos + pos / 2.0)) / (max(p) * max(n)) AS auc, sum(pos / p * tps / (tps + fps)) AS ap FROM k GROUP BY eval_set),
 c AS (SELECT eval_set, count(*) AS n_samples, avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) AS acc FROM pred_class GROUP BY eval_set)
 SELECT eval_set, n_samples, round(acc, 6) AS accuracy, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision FROM a JOIN c USING (eval_set)""",
)
def full_summary(i: Inputs):
    s = metrics.full_summary(i.pred_class, BY)
    return s.select("eval_set", "n_samples", rnd("accuracy"), rnd("roc_auc"), rnd("average_precision"))


@query(
    "P17_error_subset", ["pred_class"],
    """WITH e AS (SELECT CASE WHEN true_label = 1 THEN CASE WHEN predicted_label = 1 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN predicted_label = 1 THEN 'FP' ELSE 'TN' END END AS error_type, true_label FROM pred_class)
 SELECT CASE WHEN true_label = 1 THEN 'presences' ELSE 'background' END AS subset, error_type, count(*) AS n FROM e GROUP BY 1, 2
 UNION ALL SELECT 'all', error_type, count(*) FROM e GROUP BY 2""",
)
def error_subset(i: Inputs):
    d = i.pred_class.withColumn("error_type", metrics.error_type(F.col("true_label"), F.col("predicted_label")))
    return clean.error_subset(d).groupBy("subset", "error_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "M4_sigmoid_threshold", ["pred"],
    """SELECT sample_id, round(1 / (1 + exp(-(probability * 8 - 4))), 6) AS p, CASE WHEN probability * 8 - 4 >= 0 THEN 1 ELSE 0 END AS predicted_label FROM pred""",
)
def sigmoid_threshold(i: Inputs):
    p = metrics.sigmoid(F.col("probability") * 8 - 4)
    return i.pred.select("sample_id", rnd(p, 6, "p"), metrics.predicted_class(p).alias("predicted_label"))


@query(
    "M5_bce_logits", ["pred"],
    """SELECT eval_set, round(avg(-(true_label * ln(1 / (1 + exp(-x))) + (1 - true_label) * ln(1 - 1 / (1 + exp(-x))))), 6) AS loss
 FROM (SELECT eval_set, true_label, probability * 8 - 4 AS x FROM pred) s GROUP BY eval_set""",
)
def bce_logits(i: Inputs):
    loss = metrics.bce_from_logit(F.col("probability") * 8 - 4, F.col("true_label"))
    return i.pred.groupBy("eval_set").agg(rnd(F.avg(loss), 6, "loss"))


@query(
    "M6_epoch_metrics", ["pred"],
    """WITH r AS (SELECT eval_set, CAST(floor(sample_id / 64) AS BIGINT) AS batch, true_label, probability * 8 - 4 AS x FROM pred),
 l AS (SELECT eval_set, batch, ln(1 + exp(-abs(x))) + greatest(x, 0) - x * true_label AS loss, CASE WHEN (x > 0) = (true_label = 1) THEN 1.0 ELSE 0.0 END AS ok FROM r),
 b AS (SELECT eval_set, avg(loss) AS bl, avg(ok) AS ba FROM l GROUP BY eval_set, batch)
 SELECT eval_set, round(lb, 6) AS loss_by_batch, round(ab, 6) AS acc_by_batch, round(ls, 6) AS loss_by_sample, round(asm, 6) AS acc_by_sample
 FROM (SELECT eval_set, avg(bl) AS lb, avg(ba) AS ab FROM b GROUP BY eval_set) JOIN (SELECT eval_set, avg(loss) AS ls, avg(ok) AS asm FROM l GROUP BY eval_set) USING (eval_set)""",
)
def epoch_metrics(i: Inputs):
    d = i.pred.select(
        "eval_set", F.floor(F.col("sample_id") / 64).alias("batch"),
        (F.col("probability") * 8 - 4).alias("logit"), F.col("true_label").alias("label"),
    )
    m = metrics.epoch_metrics(d, BY, "batch")
    return m.select("eval_set", *[rnd(c) for c in ("loss_by_batch", "acc_by_batch", "loss_by_sample", "acc_by_sample")])


@query(
    "M7_early_stop", ["history"],
    """WITH b AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM history),
 f AS (SELECT *, prior IS NULL OR val_loss < prior AS better FROM b),
 s AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS waited FROM f),
 e AS (SELECT run_id, min(epoch) FILTER (waited >= 10) AS stop_epoch FROM s GROUP BY run_id)
 SELECT run_id, CAST(max(stop_epoch) AS INTEGER) AS stop_epoch, CAST(max(epoch) FILTER (better) AS INTEGER) AS best_epoch, round(min(val_loss) FILTER (better), 6) AS best_val_loss,
  count(*) FILTER (better) + count(*) FILTER (NOT better AND epoch = stop_epoch) AS n_checkpoints
 FROM s JOIN e USING (run_id) WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY run_id""",
)
def early_stop(i: Inputs):
    d = metrics.early_stop(i.history, 10)
    return d.select("run_id", F.col("stop_epoch").cast("int"), F.col("best_epoch").cast("int"), rnd("best_val_loss"), "n_checkpoints")


@query(
    "M8_best_epoch", ["history"],
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_mcc DESC, epoch) AS b, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS f FROM history)
 SELECT x.run_id, CAST(x.epoch AS INTEGER) AS best_epoch, x.val_mcc AS best_val_mcc, x.val_loss AS best_epoch_val_loss, x.val_auc AS best_epoch_val_auc,
  y.val_mcc AS final_val_mcc, y.val_loss AS final_val_loss, y.val_auc AS final_val_auc FROM r x JOIN r y ON x.run_id = y.run_id AND x.b = 1 AND y.f = 1""",
)
def best_epoch(i: Inputs):
    return metrics.best_epoch(i.history)


@query("A19_class_counts", ["occ"], "SELECT species, presence, count(*) AS n FROM occ GROUP BY 1, 2")
def class_counts(i: Inputs):
    return splits.class_counts(i.occ, ["species"])
