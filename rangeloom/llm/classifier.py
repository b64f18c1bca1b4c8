"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Every task sums the normal equations of its labelled rows; matrix rows of all tasks are added up by row number, and
the driver solves one system whose size is that of the features. Features are kept on a grid, so these sums are exact
whatever the number of tasks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, release, slices, stored

STATISTICS = (
    "words", "chars", "word_len", "word_len_spread", "longest", "upper", "digits", "symbols", "marks", "bars", "exclaims", "stops", "commas",
    "other", "lines", "same_lines", "distinct", "entropy", "commonest", "doubled", "repeated", "capital", "short", "shouted", "marked", "numbers",
)
#: Random Fourier features, kernel width in standard deviations a statistic, ridge per labelled row, bins of raw scores.
FEATURES, WIDTH, RIDGE, BINS = 512, 1.0, 1e-5, 4096
#: Statistics lie on a grid of 2^-12, features on one of 2^-10: sums of products are exact up to 2^33 rows.
GRID, FINE = 4096.0, 1024.0
#: Standardised statistics are cut here, so one strange value does not decide all features.
CUT = 4.0

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&|<>", "marks": b"\"'()[]{}/\\;:-_=+~@^`", "exclaims": b"!?", "stops": b".", "commas": b","}
_SETS = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}


def statistics(text: bytes) -> list[float]:
    """Statistics of a text, most of them shares, in the order of STATISTICS; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, counts = len(words), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    ink = max(1, int(counts[33:].sum()))
    of = {k: float(counts[s].sum()) / ink for k, s in _SETS.items()}
    lens = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    share = counts[counts > 0] / len(text)
    letters = [w[:1] for w in words]
    return [
        np.log1p(n),
        np.log1p(len(text)),
        float(np.log(lens.mean())),
        float(np.log1p(lens.std())),
        float(np.log(lens.max())),
        of["upper"],
        of["digits"],
        of["symbols"],
        of["marks"],
        float(counts[124]) / ink,
        of["exclaims"],
        of["stops"],
        of["commas"],
        float(counts[128:].sum()) / ink,
        float(np.log(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        float(np.log(len(seen)) / np.log(n + 1)),
        float(-(share * np.log2(share)).sum()),
        max(seen.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(windows) / max(1, n - 2),
        sum(map(bytes.isupper, letters)) / n,
        float((lens <= 3).mean()),
        sum(map(bytes.isupper, words)) / n,
        sum(not w.isalnum() for w in seen if w.isascii()) / len(seen),
        sum(map(bytes.isdigit, words)) / n,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, x` (array of float): statistics of every whole text, on a grid."""

    def run(batches):
        for b in slices(batches):
            x = np.array([statistics(t) for t in b.column("text").cast(pa.binary()).to_pylist()], np.float64)
            x = (np.round(x * GRID) / GRID).astype(np.float32)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows], ["doc_id", "x"])
        release()

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


class Fourier:
    """Random features whose products approximate a Gaussian kernel over standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(spread > 1e-6, spread, 1.0)
        self.turn = rng.standard_normal((len(mean), features)) / (width * np.sqrt(len(mean)))
        self.shift = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CUT, CUT)
        z = np.round(np.cos(z @ self.turn + self.shift) * FINE) / FINE
        return np.hstack([z, np.ones((len(z), 1))])


def normal_equations(rows: DataFrame, fourier: Fourier, tasks: int | None = None) -> np.ndarray:
    """Sum of outer products of (features, y) over all rows `x, y`.

    A task keeps one matrix, whatever the number of its rows, and hands it on row by row; tasks that add
    rows of equal number keep one sum for each. The result has (features + 2)^2 numbers.
    """
    size = fourier.turn.shape[1] + 2

    def add(batches):
        total = None
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                z = np.hstack([fourier(_matrix(part.column("x"))), np.round(part.column("y").to_numpy()[:, None] * FINE) / FINE])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total))], ["k", "v"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), _matrix(b.column("v")), strict=True):
                sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()))], ["k", "v"])

    schema = "k int, v array<double>"
    summed = rows.mapInArrow(add, schema).repartition(tasks or 16, "k").mapInArrow(merge, schema).toArrow()
    out = np.zeros((size, size))
    for k, v in zip(summed.column("k").to_pylist(), summed.column("v").to_pylist(), strict=True):
        out[k] = v
    return out


def isotonic(count: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing shares closest to good / count, by pooling adjacent violators: for each pool its mean place and its share."""
    pools: list[list[float]] = []
    for i in np.flatnonzero(count).tolist():
        pools.append([count[i] * (i + 0.5), float(count[i]), float(good[i])])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    place = np.array([p[0] / p[1] for p in pools])
    # Half a row of either kind in every pool keeps shares off 0 and 1.
    return place, np.maximum.accumulate([(p[2] + 0.5) / (p[1] + 1) for p in pools])


class Model:
    """What scores a document: features, weights, and the pools of raw scores."""

    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, pools: tuple[np.ndarray, np.ndarray] | None):
        self.fourier, self.weights, self.pools = fourier, weights, pools

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Raw scores as places in BINS, those from -0.5 to 1.5 with fractions."""
        raw = self.fourier(x) @ self.weights
        return np.clip((raw + 0.5) / 2, 0, 1 - 1e-9) * BINS

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), 0.5)
        return np.interp(self.bins(x), *self.pools)


def fit(rows: DataFrame, ridge: float = RIDGE) -> Model:
    """The model of labelled rows `x, y` (y from 0 to 1). All of them count; without any every score is 0.5.

    Only sums reach the driver: mean and spread of each statistic, the normal equations, counts of BINS raw scores.
    """
    d = len(STATISTICS)
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i].cast("double")).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not first["n"]:
        return Model(None, None, None)
    mean, spread = (np.round([first[f"{k}{i}"] for i in range(d)], 6) for k in "ms")
    fourier = Fourier(mean, spread)
    both = normal_equations(rows, fourier)
    a, b = both[:-1, :-1], both[:-1, -1]
    hold = np.full(len(a), ridge * first["n"])
    hold[-1] = 0.0
    model = Model(fourier, np.linalg.solve(a + np.diag(hold) + 1e-9 * np.eye(len(a)), b), None)

    def place(batches):
        for x in batches:
            if x.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(model.bins(_matrix(x.column("x")))).astype(np.int32)), x.column("y")], ["bin", "y"])

    counts = rows.mapInArrow(place, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).toArrow().to_pydict()
    count, good = np.zeros(BINS), np.zeros(BINS)
    count[counts["bin"]], good[counts["bin"]] = counts["n"], counts["y"]
    model.pools = isotonic(count, good)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, accept: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, held_out, score, predicted` of every row of `docs`, learnt from `labels` (`doc_id, quality`).

    Labels of documents whose crc32(id) mod `folds` is `held` are not learnt from. Of several labels of an id
    the mean counts; null labels and labels without a document count for nothing. A null text is empty, and
    an empty one has statistics of zero and the score that belongs to them; a null id is never held out and has no label.
    Texts are read whole and reduced to a fixed number of statistics, other columns are not read, repeated
    rows count each time, an empty table gives no rows.
    """
    stats = stored(document_statistics(docs, id_col, text_col), "statistics", "snappy")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y IS NOT NULL").groupBy("doc_id").agg(F.avg("y").alias("y"))
    train = stored(stats.filter(~held_out).join(known, "doc_id").select("x", "y"), "labelled", "snappy")
    model = fit(train)

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(model.score(_matrix(part.column("x"))), 6))], ["doc_id", "score"])
        release()

    return stats.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
