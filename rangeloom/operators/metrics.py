"""Binary evaluation metrics, many evaluation sets in one job.

Input: `true_label`, `probability`, `predicted_label`, and the `by` columns that name the set.
Undefined values are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import finite_or_null
from .joins import same_keys_join
from .ranks import prefix_sum


def sigmoid(logit: Column) -> Column:
    """Probability of a logit."""
    return 1.0 / (1.0 + F.exp(-logit))


def predicted_class(p: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """Class at a threshold; evaluation includes the threshold itself, training accuracy does not."""
    hit = p >= threshold if inclusive else p > threshold
    return F.when(hit, 1).otherwise(0)


def bce_from_logit(logit: Column, label: Column) -> Column:
    """Stable per-row log-loss."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def error_type(true: Column, pred: Column) -> Column:
    """TP, TN, FP, FN, or UNDEF."""
    return (
        F.when((true == 1) & (pred == 1), "TP")
        .when((true == 0) & (pred == 0), "TN")
        .when((true == 0) & (pred == 1), "FP")
        .when((true == 1) & (pred == 0), "FN")
        .otherwise("UNDEF")
    )


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    """tn, fp, fn, tp per set."""
    kind = error_type(F.col("true_label"), F.col("predicted_label"))
    return df.groupBy(*by).agg(*[F.count_if(kind == k.upper()).alias(k) for k in ("tn", "fp", "fn", "tp")])


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    """All threshold metrics, Brier score and mean probabilities in one pass."""
    y, p = F.col("true_label"), F.col("probability")
    kind = error_type(y, F.col("predicted_label"))
    a = df.groupBy(*by).agg(
        *[F.count_if(kind == k.upper()).alias(k) for k in ("tn", "fp", "fn", "tp")],
        F.count(F.lit(1)).alias("n_samples"),
        F.avg((p - y) * (p - y)).alias("_brier"),
        F.avg(p).alias("mean_probability"),
        F.avg(F.when(y == 1, p)).alias("mean_probability_positive"),
        F.avg(F.when(y == 0, p)).alias("mean_probability_negative"),
    )
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    pos, neg = tp + fn, tn + fp
    both = (pos > 0) & (neg > 0)
    precision, recall = _zero(_ratio(tp, tp + fp)), _zero(_ratio(tp, pos))
    # Square roots multiplied, so the product cannot overflow.
    den = F.sqrt(tp + fp) * F.sqrt(pos) * F.sqrt(neg) * F.sqrt(tn + fn)
    return a.select(
        *by, "tn", "fp", "fn", "tp", "n_samples",
        (F.col("tp") + F.col("fn")).alias("n_positive"),
        (F.col("tn") + F.col("fp")).alias("n_negative"),
        _ratio(tp + tn, F.col("n_samples")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _zero(_ratio(tp * 2, tp * 2 + fp + fn)).alias("f1"),
        _ratio(tp, pos).alias("sensitivity"),
        _ratio(tn, neg).alias("specificity"),
        F.when(both, (_ratio(tp, pos) + _ratio(tn, neg)) / 2).alias("balanced_accuracy"),
        F.when(both, _zero(_ratio(tp * tn - fp * fn, den))).alias("mcc"),
        F.when(both, F.col("_brier")).alias("brier"),
        "mean_probability", "mean_probability_positive", "mean_probability_negative",
    )


def class_report(df: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted averages, as rows."""
    c = confusion(df, by)
    tn, fp, fn, tp = (F.col(k).cast("double") for k in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def side(hit: Column, false_hit: Column, missed: Column) -> list[Column]:
        return [
            _zero(_ratio(hit, hit + false_hit)),
            _zero(_ratio(hit, hit + missed)),
            _zero(_ratio(hit * 2, hit * 2 + false_hit + missed)),
        ]

    bg, pr = side(tn, fn, fp), side(tp, fp, fn)
    acc = _zero(_ratio(tp + tn, n))
    n_bg, n_pr = tn + fp, tp + fn
    rows = {
        "Background": [*bg, n_bg],
        "Presence": [*pr, n_pr],
        "accuracy": [acc, acc, acc, acc],
        "macro avg": [*[(a + b) / 2 for a, b in zip(bg, pr)], n],
        "weighted avg": [*[_zero(_ratio(a * n_bg + b * n_pr, n)) for a, b in zip(bg, pr)], n],
    }
    names = ["precision", "recall", "f1_score", "support"]
    structs = [F.struct(F.lit(k).alias("label"), *[v.alias(m) for v, m in zip(vs, names)]) for k, vs in rows.items()]
    return c.select(*by, F.explode(F.array(*structs)).alias("r")).select(*by, "r.*")


def score_groups(df: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives per distinct score, with the counts scored higher and the set's totals.

    Rows without a score (NULL or NaN) can't be ranked and count nowhere.
    """
    y = F.col("true_label").cast("long")
    scored = df.filter(F.col("probability").isNotNull() & ~F.isnan("probability"))
    g = scored.groupBy(*by, "probability").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    return prefix_sum(g, by, "probability", ["pos", "neg"]).withColumnsRenamed({"pos_total": "n_pos", "neg_total": "n_neg"})


def _two_class(g: DataFrame) -> DataFrame:
    return g.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))


def _auc_terms() -> Column:
    return F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0)


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve, ties count one half."""
    g = score_groups(df, by).groupBy(*by).agg(F.sum(_auc_terms()).alias("_s"), F.first("n_pos").alias("p"), F.first("n_neg").alias("n"))
    return g.select(*by, _ratio(F.col("_s"), F.col("p").cast("double") * F.col("n").cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Precision averaged over the recall steps."""
    g = score_groups(df, by)
    hits = F.col("pos_above") + F.col("pos")
    part = F.col("pos") * _ratio(hits, hits + F.col("neg_above") + F.col("neg"))
    a = g.groupBy(*by).agg(F.sum(part).alias("_s"), F.first("n_pos").alias("p"), F.first("n_neg").alias("n"))
    value = F.when(F.col("n") > 0, _ratio(F.col("_s"), F.col("p")))
    return a.select(*by, value.alias("average_precision"))


def roc_curve(df: DataFrame, by: list[str], drop_collinear: bool = True) -> DataFrame:
    """fpr and tpr at each score, starting at (0, 0) with an infinite threshold; one-class sets have none.

    `drop_collinear` leaves out a point when the step into it and the step out of it are equal; the
    first and the last score always stay. The successor of a point is the row whose counts scored
    higher equal the point's own running counts: an equi-join, not a window over the set.
    """
    g = _two_class(score_groups(df, by))
    fp, tp = F.col("neg_above") + F.col("neg"), F.col("pos_above") + F.col("pos")
    pts = g.withColumn("fps", fp).withColumn("tps", tp).withColumnRenamed("probability", "threshold")
    if drop_collinear:
        nxt = g.select(
            *by, F.col("pos_above").alias("tps"), F.col("neg_above").alias("fps"),
            F.col("pos").alias("_np"), F.col("neg").alias("_nn"),
        )
        first = (F.col("pos_above") == 0) & (F.col("neg_above") == 0)
        bent = (F.col("pos") != F.col("_np")) | (F.col("neg") != F.col("_nn"))
        pts = pts.join(nxt, [*by, "tps", "fps"], "left").filter(F.col("_np").isNull() | first | bent)
    rows = pts.select(*by, "threshold", _ratio(F.col("fps"), F.col("n_neg")).alias("fpr"), _ratio(F.col("tps"), F.col("n_pos")).alias("tpr"))
    start = g.select(*by).distinct().select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return rows.unionByName(start)


def pr_curve(df: DataFrame, by: list[str]) -> DataFrame:
    """Precision and recall at each score, plus the end point (1, 0) without threshold."""
    g = _two_class(score_groups(df, by))
    hits = F.col("pos_above") + F.col("pos")
    rows = g.select(
        *by, F.col("probability").alias("threshold"),
        _ratio(hits, hits + F.col("neg_above") + F.col("neg")).alias("precision"),
        _ratio(hits, F.col("n_pos")).alias("recall"),
    )
    end = g.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return rows.unionByName(end)


def full_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Threshold metrics with both threshold-free areas."""
    g = score_groups(df, by)
    hits = F.col("pos_above") + F.col("pos")
    ap = F.col("pos") * _ratio(hits, hits + F.col("neg_above") + F.col("neg"))
    a = g.groupBy(*by).agg(
        F.sum(_auc_terms()).alias("_auc"), F.sum(ap).alias("_ap"), F.first("n_pos").alias("_p"), F.first("n_neg").alias("_n")
    )
    areas = a.select(
        *by, _ratio(F.col("_auc"), F.col("_p").cast("double") * F.col("_n").cast("double")).alias("roc_auc"),
        F.when(F.col("_n") > 0, _ratio(F.col("_ap"), F.col("_p"))).alias("average_precision"),
    )
    return same_keys_join(summary(df, by), areas, by, "left")


def fold_nanmean(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Mean over folds ignoring missing values."""
    return df.groupBy(*by).agg(*[F.avg(finite_or_null(F.col(c))).alias(f"mean_{c}") for c in cols])


def epoch_metrics(df: DataFrame, by: list[str], batch: str) -> DataFrame:
    """Loss and accuracy per epoch, averaged over batches and over samples. Input: `logit`, `label`, batch."""
    loss = bce_from_logit(F.col("logit"), F.col("label"))
    right = (predicted_class(sigmoid(F.col("logit")), inclusive=False) == F.col("label")).cast("double")
    b = df.groupBy(*by, batch).agg(
        F.avg(loss).alias("_l"), F.avg(right).alias("_a"), F.sum(loss).alias("_ls"), F.sum(right).alias("_as"), F.count(F.lit(1)).alias("_n")
    )
    return b.groupBy(*by).agg(
        F.avg("_l").alias("loss_by_batch"), F.avg("_a").alias("acc_by_batch"),
        (F.sum("_ls") / F.sum("_n")).alias("loss_by_sample"), (F.sum("_as") / F.sum("_n")).alias("acc_by_sample"),
    )


def early_stop(df: DataFrame, patience: int) -> DataFrame:
    """Per run: best loss, its epoch, and the epoch training stops at (NULL when it never does).

    An epoch improves when its loss is below every earlier one; NaN never improves.
    """
    loss = F.when(F.isnan("val_loss"), None).otherwise(F.col("val_loss"))
    w = W.partitionBy("run_id").orderBy("epoch")
    prior = F.min(loss).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = df.withColumn("_better", loss.isNotNull() & (prior.isNull() | (loss < prior)))
    last = F.max(F.when(F.col("_better"), F.col("epoch"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_wait", F.col("epoch") - F.coalesce(last, F.lit(-1)))
    stop = F.min(F.when(F.col("_wait") >= patience, F.col("epoch"))).over(W.partitionBy("run_id"))
    d = d.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop")))
    return d.groupBy("run_id").agg(
        F.max("_stop").alias("stop_epoch"),
        F.max(F.when(F.col("_better"), F.col("epoch"))).alias("best_epoch"),
        F.min(F.when(F.col("_better"), F.col("val_loss"))).alias("best_val_loss"),
        (F.count_if(F.col("_better")) + F.count_if(~F.col("_better") & (F.col("epoch") == F.col("_stop")))).alias("n_checkpoints"),
    )


def best_epoch(df: DataFrame) -> DataFrame:
    """Best epoch by validation MCC (earliest on ties) and the final epoch, per run."""
    r = F.struct("epoch", "val_mcc", "val_loss", "val_auc")
    # Larger MCC wins; among equals the earlier epoch.
    order = F.struct(F.col("val_mcc"), -F.col("epoch"))
    a = df.groupBy("run_id").agg(F.max_by(r, order).alias("b"), F.max_by(r, F.col("epoch")).alias("f"))
    return a.select(
        "run_id", F.col("b.epoch").alias("best_epoch"), F.col("b.val_mcc").alias("best_val_mcc"),
        F.col("b.val_loss").alias("best_epoch_val_loss"), F.col("b.val_auc").alias("best_epoch_val_auc"),
        F.col("f.val_mcc").alias("final_val_mcc"), F.col("f.val_loss").alias("final_val_loss"),
        F.col("f.val_auc").alias("final_val_auc"),
    )
