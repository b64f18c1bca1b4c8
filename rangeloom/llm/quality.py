"""Quality rules: fixed text statistics, then robust multivariate outliers per language and source.

Only DataFrame functions: no Python runs on the executors. Each group's location and scatter are
minimum-covariance-determinant estimates: concentration steps from the coordinate medians, each keeping the
nearest `SUPPORT` of the documents by Mahalanobis distance. Statistics are rounded to a grid, so all sums are
exact integers and results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart, stored, stored_few

GRID = 1024
STEPS = 3
SUPPORT = 0.75
#: Makes the scatter of the nearest 75 % of four normal variables that of all.
CONSISTENCY = 1.485
#: Smallest standard deviation of each transformed statistic: word length, symbols, repeated lines, repeated words.
SPREADS = (0.12, 0.3, 0.5, 0.5)
#: Documents of the whole corpus's estimate that a group's own is mixed with; keeps small groups sane.
PRIOR = 20
#: Squared distance of which one of 10,000 normal vectors of four is beyond.
CUTOFF = 23.5
#: Distances are binned by sixteenths, at most so many bins.
BINS = 4096
P = len(SPREADS)


def text_statistics(text: Column) -> list[tuple[str, Column]]:
    """Named columns, to be added one after the other; those from `n_words` on are results (a null text has no words)."""
    space = " \t\n\x0b\x0c\r"
    c = F.col
    w, h, s, r = c("_q_w"), c("_q_h"), c("_q_s"), c("_q_r")
    near = lambda x, k, d: F.coalesce(F.get(s, k + d)["h"] == x["h"], F.lit(False))
    lines = F.filter(F.split(c("_q_t"), "\n"), lambda x: F.length(F.translate(x, space, "")) > 0)
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    # Starts of windows found twice or more, in order: a sort by hash brings equal ones together.
    sorted_windows = F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    starts = F.array_sort(F.transform(F.filter(s, lambda x, k: near(x, k, -1) | near(x, k, 1)), lambda x: x["i"]))
    covered = F.aggregate(F.transform(r, lambda v, k: F.coalesce(F.least(F.lit(3), F.get(r, k + 1) - v), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return [
        ("_t", F.coalesce(text.cast("string"), F.lit(""))),
        ("_w", F.filter(F.split(c("_q_t"), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")),
        ("_h", windows),
        ("_s", sorted_windows),
        ("_r", starts),
        ("n_words", F.size(w).cast("long")),
        ("word_chars", F.length(F.translate(c("_q_t"), space, "")).cast("long")),
        ("n_symbols", (F.length("_q_t") - F.length(F.translate(c("_q_t"), "#*$%&|<>", ""))).cast("long")),
        ("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")),
        ("n_lines", F.size(lines).cast("long")),
        ("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))),
    ]


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _grid(x: Column) -> Column:
    return F.floor(x * GRID + 0.5).cast("long")


def with_statistics(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """`docs` plus one column `_q`: the group, the statistics and the transformed vector on the grid."""
    df, names = docs, []
    for name, expr in text_statistics(F.col(f"`{text_col}`")):
        inner = name if name.startswith("_") else f"_{name}"
        df = df.withColumn(f"_q{inner}", expr)
        names.append((name, f"_q{inner}"))
    n = {k: F.col(v) for k, v in names}
    failed = (n["n_words"] < 50) | (100 * n["n_repeat_words"] > 50 * n["n_words"])
    words, lines = F.greatest(n["n_words"], F.lit(1)).cast("double"), F.greatest(n["n_lines"], F.lit(1)).cast("double")
    vector = [
        F.log(F.greatest(n["word_chars"], F.lit(1)) / words),
        F.log(1.0 + 20.0 * (n["n_symbols"] / words)),
        F.log(1.0 + 10.0 * (n["n_dup_lines"] / lines)),
        F.log(1.0 + 5.0 * (n["n_repeat_words"] / words)),
    ]
    group = [F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source")]
    q = F.struct(*group, *[n[k].alias(k) for k in RESULTS[:-1]], failed.alias("base_failed"), *[_grid(x).alias(f"x{i}") for i, x in enumerate(vector)])
    return df.withColumn("_q", q).select(*[f"`{c}`" for c in docs.columns], "_q")


def _medians(rows: DataFrame, by: list[str]) -> DataFrame:
    """Lower median of every coordinate, from counts of grid values."""
    long = rows.select(*by, F.posexplode(F.array(*[f"x{i}" for i in range(P)])).alias("f", "v")).groupBy(*by, "f", "v").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by, "f")
    at = long.withColumn("cum", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w)).filter(2 * F.col("cum") >= F.col("all"))
    return at.groupBy(*by, "f").agg(F.min("v").alias("m")).groupBy(*by).agg(*[F.max(F.when(F.col("f") == i, F.col("m"))).alias(f"m{i}") for i in range(P)])


def _factor(df: DataFrame) -> DataFrame:
    """Cholesky factor `l_ij` of the covariances `c_ij`."""
    for i in range(P):
        for j in range(i + 1):
            x = F.col(f"c{i}{j}")
            for k in range(j):
                x = x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(x) if i == j else x / F.col(f"l{j}{j}"))
    return df


def _distance(df: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance `d2` of `x_i` from `m_i` under the factor `l_ij`."""
    for i in range(P):
        z = F.col(f"x{i}") / float(GRID) - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    d2 = F.col("z0") * F.col("z0")
    for i in range(1, P):
        d2 = d2 + F.col(f"z{i}") * F.col(f"z{i}")
    return df.withColumn("d2", d2)


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in _PAIRS]]


def _concentrate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums over the nearest `SUPPORT` of each group's rows (those of the last bin of distance included)."""
    bins = _distance(rows).withColumn("bin", F.least(F.floor(F.sqrt("d2") * 16.0), F.lit(BINS)).cast("long"))
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS]]
    per = bins.groupBy(*by, "bin").agg(*sums)
    # At most BINS rows of a group reach this window.
    w = W.partitionBy(*by)
    per = per.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(w))
    return per.filter(F.col("before") < F.col("all") * SUPPORT).groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _estimate(sums: DataFrame) -> DataFrame:
    """Means and factored covariances from sums, with the smallest spreads added."""
    df = sums.select("*", *[(F.col(f"s{i}") / F.col("n") / float(GRID)).alias(f"m{i}") for i in range(P)])
    for i, j in _PAIRS:
        c = (F.col(f"s{i}{j}") / F.col("n") / float(GRID * GRID) - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
        df = df.withColumn(f"c{i}{j}", F.greatest(c, F.lit(0.0)) + SPREADS[i] ** 2 if i == j else c)
    return _factor(df).select(*[c for c in df.columns if c[0] not in "sc" or c == "source"], *[f"l{i}{j}" for i, j in _PAIRS])


def _start(medians: DataFrame) -> DataFrame:
    """Medians with the smallest spreads as scatter."""
    df = medians.select(*[c for c in medians.columns if c[0] != "m"], *[(F.col(f"m{i}") / float(GRID)).alias(f"m{i}") for i in range(P)])
    return df.select("*", *[F.lit(SPREADS[i] if i == j else 0.0).alias(f"l{i}{j}") for i, j in _PAIRS])


def _numbers(one: DataFrame) -> dict[str, Column]:
    """The means and factors of a one-row table as named constants."""
    row = one.select(*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _PAIRS]).first().asDict()
    return {k: F.lit(v).cast("double").alias(k) for k, v in row.items()}


_KEYS = ["g_lang", "g_source"]


def _keyed(df: DataFrame) -> DataFrame:
    """Group keys of which null is a value of its own."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    return df.withColumns({"g_lang": mark("lang"), "g_source": mark("source")})


def estimates(rows: DataFrame) -> DataFrame:
    """Rows `g_lang, g_source, m_i, l_ij` of rows `lang, source, x_i` (those that the fixed rules accept)."""
    rows = _keyed(rows).select(*_KEYS, *[f"x{i}" for i in range(P)])
    # The whole corpus's estimate is one row, whose numbers go into the next step's plan.
    whole = _numbers(_start(_medians(rows, [])))
    for _ in range(STEPS):
        whole = _numbers(_estimate(_concentrate(rows.select("*", *whole.values()), [])))
    own = stored(_start(_medians(rows, _KEYS)), "groups", "snappy")
    n_groups = own.count()
    for step in range(STEPS):
        sums = _concentrate(rows.join(own, _KEYS), _KEYS)
        if step == STEPS - 1:
            # Mix with PRIOR documents at the whole corpus's location.
            sums = sums.withColumn("n_own", F.col("n"))
        est = _estimate(sums)
        if step == STEPS - 1:
            est = est.select(*_KEYS, *[((F.col(f"m{i}") * F.col("n_own") + whole[f"m{i}"] * float(PRIOR)) / (F.col("n_own") + float(PRIOR))).alias(f"m{i}") for i in range(P)], *[f"l{i}{j}" for i, j in _PAIRS])
        own = stored_few(est, "groups", n_groups)
    return own


def judged(stats: DataFrame) -> DataFrame:
    """Stored rows with `_q` plus `_kept`: not failed, and within the cutoff of their group's estimate."""
    rows = stats.filter(~F.col("_q.base_failed")).select("_q.lang", "_q.source", *[f"_q.x{i}" for i in range(P)])
    own = estimates(rows).select(F.struct("*").alias("_e"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    on = (key("_q.lang") == F.col("_e.g_lang")) & (key("_q.source") == F.col("_e.g_source"))
    z: list[Column] = []
    for i in range(P):
        v = F.col(f"_q.x{i}") / float(GRID) - F.col(f"_e.m{i}")
        for j in range(i):
            v = v - F.col(f"_e.l{i}{j}") * z[j]
        z.append(v / F.col(f"_e.l{i}{i}"))
    d2 = z[0] * z[0]
    for v in z[1:]:
        d2 = d2 + v * v
    joined = stats.join(own, on, "left").withColumn("_d2", d2)
    return joined.withColumn("_kept", ~F.col("_q.base_failed") & (F.col("_d2") <= CUTOFF)).drop("_e")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows `doc_id`, the fixed statistics, `base_failed`, `kept` and `distance2`, one for each row of `docs`.

    A null or empty text has no words and fails the fixed rules. Null languages and sources are groups of their
    own; repeated rows count and are judged each; extra columns are ignored; an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = stored(with_statistics(named, "text", "lang", "source").drop("text", "lang", "source"), "statistics")
    return judged(stats).select("doc_id", *[f"_q.{c}" for c in RESULTS], F.col("_kept").alias("kept"), F.col("_d2").alias("distance2"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (columns `text, lang, source` and any others) that the rules keep, with their columns."""
    rows = apart(docs, ("text", "lang", "source"))
    stats = stored(with_statistics(rows, "text", "lang", "source"), "documents")
    return judged(stats).filter("_kept").select(*rows.columns).toDF(*docs.columns)
