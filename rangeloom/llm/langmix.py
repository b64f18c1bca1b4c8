"""Language ID by mixtures: expectation-maximisation finds each document's language shares from n-gram likelihoods.

A language is a table of byte-trigram frequencies of its words. A document is a mixture: each word was drawn
from one language. The set of languages is grown from the best single one while the penalised likelihood rises.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, release, slices
from .words import Ids, Numbers

BUCKETS = 1 << 16
SMOOTH = 0.5
ROUNDS = 12
#: Cost in log-likelihood of a further language, times log(words + 1).
PENALTY = 3.0
MAX_LANGUAGES = 400
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column, modulus: int = 4, rest: int = 2) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text (null: empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall(text.lower()) if text else []


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram of the words with a space on both sides, and how many each word has."""
    data = [w.encode() for w in words]
    size = np.fromiter(map(len, data), np.int64, len(data))
    b = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
    code ^= code >> np.uint32(15)
    inside = b[1:-1] != 32
    return ((code * np.uint32(2654435769)) >> np.uint32(16))[inside], size


_GRAMS: list[Ids] = []


def _grams() -> Ids:
    """Word -> trigram buckets, one table per Python worker."""
    if not _GRAMS:

        def fill(new):
            code, size = trigrams(new)
            return np.split(code, np.cumsum(size)[:-1])

        _GRAMS.append(Ids(fill, limit=150_000, keep=60_000))
    return _GRAMS[0]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (language x bucket), from labelled documents that are not held out.

    Counts cover all of them; a task sends one row per language and bucket, at most, and the driver gets
    languages x 65,536 sums. More than `MAX_LANGUAGES` labels raise an error.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    n = rows.select("lang").distinct().count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"{n} languages, at most {MAX_LANGUAGES} can be learned")

    def count(batches):
        table, total = _grams(), {}
        for b in slices(batches):
            pieces = [words_of(t) for t in b.column("text").to_pylist()]
            codes, sizes = table.encode(pieces)
            ends = np.append(0, np.cumsum(sizes))
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in set(langs):
                own = np.concatenate([codes[ends[i] : ends[i + 1]] for i in np.flatnonzero(langs == lang)])
                total[lang] = total.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
        _GRAMS.clear()
        table = None
        release()
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    c = np.zeros((len(langs), BUCKETS))
    row = {x: i for i, x in enumerate(langs)}
    c[[row[x] for x in counts.column("lang").to_pylist()], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return langs, np.log((c + SMOOTH) / (c.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)


def mixture(rel: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shares (document x language) and log-likelihoods by expectation-maximisation.

    `rel`: likelihood of every word (rows) in every language, relative to its best; documents are the runs
    (starts, sizes > 0); only `allowed` languages take part.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        mix = rel * np.repeat(share.astype(np.float32), sizes, axis=0)
        mix /= np.maximum(mix.sum(axis=1, keepdims=True), np.float32(1e-30))
        share = np.add.reduceat(mix, starts, axis=0) / sizes[:, None]
    mix = (rel * np.repeat(share.astype(np.float32), sizes, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(mix, np.float32(1e-30))).astype(np.float64), starts)


def select(rel: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shares of the languages of the chosen set of every document (all sizes > 0)."""
    n, k = len(sizes), rel.shape[1]
    starts = np.cumsum(sizes) - sizes
    single = np.add.reduceat(np.log(np.maximum(rel, np.float32(1e-30))).astype(np.float64), starts, axis=0)
    chosen = np.zeros((n, k), bool)
    chosen[np.arange(n), single.argmax(axis=1)] = True
    share, best = chosen.astype(float), single.max(axis=1)
    cost = PENALTY * np.log(sizes + 1)
    full, most = mixture(rel, starts, sizes, np.ones((n, k)))
    # No set is likelier than all languages together, so a small gain of those settles it.
    open_ = np.flatnonzero(most - best > cost)
    while len(open_):
        at = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in open_])
        r, z = rel[at], sizes[open_]
        s = np.cumsum(z) - z
        gain, pick, shares = np.full(len(open_), -np.inf), np.zeros(len(open_), np.int64), share[open_].copy()
        for lang in np.flatnonzero((full[open_] * z[:, None] > 1).any(axis=0)):
            allowed = chosen[open_].copy()
            new = ~allowed[:, lang]
            allowed[:, lang] = True
            got, like = mixture(r, s, z, allowed.astype(float))
            better = new & (like - best[open_] > gain)
            gain[better], pick[better], shares[better] = (like - best[open_])[better], lang, got[better]
        take = gain > cost[open_]
        open_ = open_[take]
        chosen[open_, pick[take]] = True
        best[open_] += gain[take]
        share[open_] = shares[take]
        open_ = open_[most[open_] - best[open_] > cost[open_]]
    return share


_RESULT = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("languages", T.ArrayType(T.StringType())).add("shares", T.ArrayType(T.DoubleType()))


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", out: str = "_language") -> DataFrame:
    """`docs` with a struct `out`: `lang_pred`, `score` (its share), and all `languages` of the text with their `shares`.

    A null text, or one without letters, is `und` with score 0 and no languages, as is every text if
    nothing was learned. Rows are independent of each other; all other columns pass through.
    """
    langs, table = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, table))  # languages x 65,536, see learn()
    limit = max(1 << 16, min(2 << 20, (8 << 20) // max(1, len(langs))))

    def run(batches):
        langs, table = sent.value

        def fill(new):
            code, size = trigrams(new)
            like = np.add.reduceat(table[:, code].T, np.cumsum(size) - size, axis=0)
            return np.exp(like - like.max(axis=1, keepdims=True))

        known = Numbers(fill, np.float32, width=len(langs), limit=250_000, keep=100_000) if langs else None
        for b in slices(batches, text_col, limit):
            pieces = [words_of(t) if langs else [] for t in b.column(text_col).cast(pa.string()).to_pylist()]
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            share = np.zeros((len(sizes), max(1, len(langs))))
            some = np.flatnonzero(sizes)
            if len(some):
                rows = known.rows([w for p in pieces for w in p])
                share[some] = select(known.values[rows], sizes[some])
            rows = []
            for s in share:
                order = np.argsort(-s, kind="stable")
                order = order[s[order] > 0]
                rows.append({"lang_pred": langs[order[0]] if len(order) else "und", "score": min(1.0, float(s[order[0]])) if len(order) else 0.0, "languages": [langs[i] for i in order], "shares": [float(s[i]) for i in order]})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, _ARROW)], [*b.schema.names, out])
        known = None
        release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, _RESULT)]))


_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows `doc_id, held_out, lang_pred, score, languages, shares`, one for each row of `docs`.

    Only labels of documents that are not held out are learned from; a prediction sees the text alone.
    """
    model = learn(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_language(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_language.*")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` (columns `doc_id, text, lang` and any others) of which one language has a share of `least` or more."""
    own = apart(docs, ("doc_id", "text", "lang"))
    rows = with_language(own, learn(own))
    return rows.filter((F.col("_language.lang_pred") != "und") & (F.col("_language.score") >= least)).select(*own.columns).toDF(*docs.columns)
