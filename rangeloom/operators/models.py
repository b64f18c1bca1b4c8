"""Tabular fitting with pyspark.ml and batched scoring of a fixed network."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import FAMILY_ALIASES, family_inputs


def fit_tabular(train: DataFrame, features: list[str], label: str = "presence", estimator: Estimator | None = None) -> PipelineModel:
    """Binary classifier on the ordered features; any pyspark.ml classifier may be given."""
    est = estimator or LogisticRegression(maxIter=30, regParam=1e-4)
    est = est.copy({est.featuresCol: "_features", est.labelCol: label})
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="error"), est]).fit(train)


def score_tabular(model: PipelineModel, df: DataFrame, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """Probability of presence and the class at a threshold."""
    p = vector_to_array("probability")[1]
    out = model.transform(df).select(*keep, p.alias("p"))
    return out.withColumnRenamed("p", "probability").withColumn("predicted_label", (F.col("probability") >= threshold).cast("int"))


def fit_rounds(df: DataFrame, features: list[str], rounds: list[int], keep: list[str], label: str = "presence") -> DataFrame:
    """One model per cross-validation round (a fixed small number), each scored on its held-out rows."""
    parts = []
    for r in rounds:
        one = df.filter(F.col("cv_round") == r)
        model = fit_tabular(one.filter("split = 'train'"), features, label)
        parts.append(score_tabular(model, one.filter("split = 'test'"), keep))
    return reduce(DataFrame.unionByName, parts)


def compare_families(train: DataFrame, test: DataFrame, inputs: dict[str, list[str]], keep: list[str], label: str = "presence") -> DataFrame:
    """Fit the seven input combinations on column subsets (`image`, `topo`, `tabular`) and score each."""
    parts = []
    for family in FAMILY_ALIASES:
        cols = [c for part in ("image", "topo", "tabular") if part in family_inputs(family) for c in inputs[part]]
        model = fit_tabular(train, cols, label)
        parts.append(score_tabular(model, test, keep).withColumn("model_type", F.lit(family)))
    return reduce(DataFrame.unionByName, parts)


def mlp_weights(n_in: int, widths: tuple[int, int, int] = (128, 128, 256), seed: int = 0) -> dict[str, np.ndarray]:
    """Random weights in the layout the scorer reads; for trials and tests."""
    g = np.random.default_rng(seed)
    dims = [n_in, *widths, 1]
    w: dict[str, np.ndarray] = {}
    for i in range(4):
        w[f"w{i}"] = g.normal(0, dims[i] ** -0.5, (dims[i], dims[i + 1]))
        w[f"b{i}"] = g.normal(0, 0.1, dims[i + 1])
        if i < 2:
            w[f"scale{i}"], w[f"shift{i}"] = np.ones(dims[i + 1]), np.zeros(dims[i + 1])
    return w


def _drop_mask(ids: np.ndarray, pass_no: int, layer: int, units: int, rate: float, seed: int) -> np.ndarray:
    """Keep mask scaled by 1 / (1 - rate); a hash of (sample, pass, layer, unit), so batches do not matter."""
    z = ids.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(units, dtype=np.uint64)[None, :]
    salt = ((seed * 64 + pass_no) * 4 + layer + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    z = z + np.uint64(salt)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(mult)
    u = (z ^ (z >> np.uint64(31))) / np.float64(2**64)
    return (u >= rate) / (1 - rate)


def mlp_logits(x: np.ndarray, w: dict[str, np.ndarray], masks: list[np.ndarray] | None = None) -> np.ndarray:
    """Linear, ReLU, LayerNorm twice; then Linear, ReLU, Linear. Masks follow the first norm and the last ReLU."""
    h = x
    for i in range(2):
        h = np.maximum(h @ w[f"w{i}"] + w[f"b{i}"], 0.0)
        h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5) * w[f"scale{i}"] + w[f"shift{i}"]
        if masks and i == 0:
            h = h * masks[0]
    h = np.maximum(h @ w["w2"] + w["b2"], 0.0)
    if masks:
        h = h * masks[1]
    return (h @ w["w3"] + w["b3"])[:, 0]


def score_mlp(df: DataFrame, ident: str, features: str, weights: dict[str, np.ndarray], passes: int = 0, rate: float = 0.25, seed: int = 0) -> DataFrame:
    """Logit per row and pass, one matrix product per Arrow batch; `passes` 0 scores once without dropout.

    The weights are a fixed model (well under a megabyte here) and are broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            x = np.stack([np.asarray(v, dtype=float) for v in b[features]]) if len(b) else np.zeros((0, w["w0"].shape[0]))
            ids = b[ident].to_numpy()
            for t in range(max(passes, 1)):
                masks = None
                if passes:
                    masks = [_drop_mask(ids, t, k, w[f"w{n}"].shape[1], rate, seed) for k, n in ((0, 0), (1, 2))]
                yield pd.DataFrame({ident: ids, "pass": np.int32(t), "logit": mlp_logits(x, w, masks)})

    return df.select(ident, features).mapInPandas(run, f"{ident} long, pass int, logit double")
