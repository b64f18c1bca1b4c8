"""Language-model scores of whole documents: corpus counts gathered over word buckets, a gated recurrent model on top.

Texts are cut into blocks of a few megabytes. Each block sends the words it holds, packed, to the buckets of
their hashes; a bucket sums the counts of all blocks and sends each block its words' counts back. So every
word of the corpus is counted, and what a task holds is bounded by a block or a bucket, of which there are
more when the input is larger. Then each text is stored as the symbols the recurrent model reads, two bytes
a token, which is all that training and scoring read.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import id_text, scratch, slices, stored
from .langmix import held_out

BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
#: Tokens of one training task; there are more tasks when the input is larger, and their weights are averaged.
TASK_TOKENS = 4_000_000
#: Tokens that are scored together.
SCORE_TOKENS = 4_000_000
MODULUS, REST = 7, 2
_END = b""  # no word is empty
_CHUNK = 1024
#: A count and a place among its bucket's most frequent words share a number.
_PLACES = 2048


class _Rows(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words in order of appearance, the number of each token's word, and tokens per text (with the end)."""
    rows, pieces = _Rows(), [t.lower().split() for t in texts]
    for p in pieces:
        p.append(_END)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    index = np.fromiter(map(rows.__getitem__, chain.from_iterable(pieces)), np.int64, int(sizes.sum()))
    return list(rows), index, sizes


def _by_bucket(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, and the words' order by bucket."""
    of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    return of, np.argsort(of, kind="stable")


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of numbers as one binary value each."""
    data, ends = values.tobytes(), np.cumsum(sizes) * values.itemsize
    return pa.array([data[e - n : e] for e, n in zip(ends.tolist(), (sizes * values.itemsize).tolist(), strict=True)], pa.binary())


def prepare(docs: DataFrame, buckets: int) -> DataFrame:
    """Stored rows `kind, block, at, doc_id, held, data, n`: 0 a text, 1 the words of a block in a bucket with training counts.

    A text is the numbers of its words (four bytes a token, the end included): places among the words of its block by bucket.
    """
    schema = "kind int, block long, at int, doc_id long, held boolean, data binary, n binary"

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for b in slices(batches, "data", BLOCK_BYTES):
            block, held = (part << 32) | seq, np.array(b.column("held").to_pylist(), bool)
            seq += 1
            words, index, sizes = tokens(b.column("data").to_pylist())
            count = np.bincount(index[np.repeat(~held, sizes)], minlength=len(words))
            of, order = _by_bucket(words, buckets)
            number = np.empty(len(words), "<u4")
            number[order] = np.arange(len(words))
            k, numbers = b.num_rows, packed(number[index], sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(k, np.int32)), pa.array(np.full(k, block)), pa.array(np.arange(k, dtype=np.int32)), b.column("doc_id"), b.column("held"), numbers, pa.nulls(k, pa.binary())], _names(schema)
            )
            cuts = np.flatnonzero(np.diff(of[order])) + 1
            rows = [(int(of[o[0]]), b"\n".join([words[i] for i in o]), count[o].astype("<i8").tobytes()) for o in np.split(order, cuts)]
            k = len(rows)
            at, data, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, np.int32)), pa.array(np.full(k, block)), pa.array(at, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.array(data, pa.binary()), pa.array(n, pa.binary())], _names(schema)
            )

    path = scratch(docs.sparkSession, "blocks")
    docs.mapInArrow(run, schema).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    # The kind is a folder now; texts and words are read apart.
    return docs.sparkSession.read.schema(schema).parquet(path)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def corpus_counts(blocks: DataFrame) -> DataFrame:
    """Stored rows `kind, block, at, place, n, word, c`: 0 of a block's words of a bucket, 1 sums of a bucket, 2 its most frequent words.

    `n` holds the counts of the block's words, each with the word's place among the bucket's most frequent ones (0: none).
    """
    schema = "kind int, block long, at int, place int, n binary, word binary, c long"

    def count(table: pa.Table) -> pa.Table:
        rows, index, weight = _Rows(), [], []
        for words, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True):
            words = words.split(b"\n")
            index.append(np.fromiter(map(rows.__getitem__, words), np.int64, len(words)))
            weight.append(np.frombuffer(n, "<i8"))
        total = np.zeros(len(rows), np.int64)
        for i, w in zip(index, weight, strict=True):
            total[i] += w  # a word stands once in a block
        words = list(rows)
        # The most frequent words overall are among the most frequent of their buckets.
        top = [i for i in np.lexsort((np.arange(len(words)), -total))[: gru.FREQUENT + 1] if total[i] and words[i]]
        both = total * _PLACES
        both[top] += np.arange(1, len(top) + 1)
        ats = table.column("at").to_pylist()
        out = [(0, block, at, None, both[i].astype("<i8").tobytes(), None, None) for block, at, i in zip(table.column("block").to_pylist(), ats, index, strict=True)]
        ends = int(total[rows[_END]]) if _END in rows else 0
        sums = {b"tokens": total.sum(), b"distinct": (total > 0).sum(), b"single": (total == 1).sum() - (ends == 1), b"ends": ends}
        out += [(1, None, None, None, None, k, int(v)) for k, v in sums.items()]
        out += [(2, None, ats[0], place, None, words[i], int(total[i])) for place, i in enumerate(top, 1)]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=_names(schema))

    path = scratch(blocks.sparkSession, "counts")
    words = blocks.filter("kind = 1").select("block", "at", "data", "n")
    words.groupBy("at").applyInArrow(count, schema).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return blocks.sparkSession.read.schema(schema).parquet(path)


def as_symbols(blocks: DataFrame, counts: DataFrame, frequent: dict[tuple[int, int], int], n: int, v: int, single: int, weight: int) -> DataFrame:
    """Stored rows `doc_id, held, block, at, n_tokens, n_known, base, inside, symbols`, one for each text.

    `frequent`: symbols of the frequent words by bucket and place. `inside`: the sum of the log10 shares that rare and unknown
    words have of their class. `symbols`: two bytes a token.
    """
    schema = "doc_id long, held boolean, block long, at int, n_tokens long, n_known long, base double, inside double, symbols binary"
    keys = np.array(sorted(at * _PLACES + place for at, place in frequent), np.int64)
    values = np.array([frequent[divmod(int(k), _PLACES)] for k in keys], np.int64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("at"), right.sort_by("at")
        parts = [np.frombuffer(x, "<i8") for x in right.column("n").to_pylist()]
        c, place = np.divmod(np.concatenate(parts), _PLACES)
        key = np.repeat(right.column("at").to_numpy().astype(np.int64), [len(x) for x in parts]) * _PLACES + place
        kind = np.where(c > 0, gru.RARE, gru.UNKNOWN)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            own = (place > 0) & (keys[at] == key)
            kind[own] = values[at[own]]
        data = left.column("data").to_pylist()
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
        index, ends = np.frombuffer(b"".join(data), "<u4"), np.cumsum(sizes)
        kind[index[-1]] = gru.END  # the word of the last token of every text
        inside = np.where(kind == gru.RARE, np.log10(np.maximum(c, 1) / weight), np.where(kind == gru.UNKNOWN, np.log10((single + 1) / weight), 0.0))
        starts = ends - sizes
        base = np.add.reduceat(np.log10(c + 1.0)[index], starts) - sizes * np.log10(n + 1.0 * (v + 1))
        known = np.add.reduceat((c > 0)[index].astype(np.int64), starts)
        cols = [left.column(k) for k in ("doc_id", "held", "block", "at")] + [pa.array(x) for x in (sizes, known, base, np.add.reduceat(inside[index], starts))]
        return pa.table([*cols, packed(kind[index].astype("<i2"), sizes)], names=_names(schema))

    by = lambda df: df.groupBy("block")
    texts = blocks.filter("kind = 0").select("block", "at", "doc_id", "held", "data")
    return stored(by(texts).cogroup(by(counts.filter("kind = 0").select("block", "at", "n"))).applyInArrow(run, schema), "symbols")


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<i2"), np.fromiter(map(len, data), np.int64, len(data)) // 2


def fit(texts: DataFrame, start: dict, n_tokens: int) -> dict:
    """Recurrent weights from all documents that are not held out, each of them in one round.

    The documents are dealt to rounds by hash of id and place, and each round starts from the mean of the one before.
    There is one round more each time the training tasks double.
    """
    total = max(1, round(n_tokens / TASK_TOKENS))
    rounds = total.bit_length()
    for k in range(rounds):
        share = F.pmod(F.xxhash64("doc_id", "block", "at", F.lit("train")), F.lit(rounds)) == k
        start = _fit_round(texts.filter(~F.col("held") & share), start, max(1, round(total / rounds)))
    return start


def _fit_round(share: DataFrame, start: dict, tasks: int) -> dict:
    """Training tasks start from the same weights, and the mean of what they reach is taken."""

    def run(batches):
        got = [_symbols(b.column("symbols")) for b in batches if b.num_rows]
        if not got:
            return
        symbols, sizes = (np.concatenate(x) for x in zip(*got, strict=True))
        total = len(symbols)
        flat = gru.flatten(gru.train(start, symbols, sizes)).astype(np.float64)
        parts = [flat[i : i + _CHUNK] * total for i in range(0, len(flat), _CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([total] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64()))], ["chunk", "tokens", "x"])

    def add(batches):
        # One sum for each chunk of weights, however many tasks sent it.
        sums: dict[int, list] = {}
        for b in batches:
            for k, n, x in zip(b.column("chunk").to_pylist(), b.column("tokens").to_pylist(), b.column("x"), strict=True):
                x = x.values.to_numpy()
                sums[k] = [sums[k][0] + n, sums[k][1] + x] if k in sums else [n, x]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v / n for n, v in sums.values()], pa.list_(pa.float64()))], ["chunk", "x"])

    # Rows in a fixed order, so a task that is run again gives the same weights.
    rows = share.repartition(tasks, "block", "at").sortWithinPartitions("block", "at").select("symbols")
    got = rows.mapInArrow(run, "chunk int, tokens long, x array<double>")
    mean = got.repartition("chunk").mapInArrow(add, "chunk int, x array<double>").toArrow()
    if not mean.num_rows:
        return start
    mean = mean.sort_by("chunk")
    flat = np.concatenate([x.values.to_numpy() for x in mean.column("x")])
    out = gru.unflatten(flat, start)
    out["embed"][gru.UNKNOWN] = out["embed"][gru.RARE]
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`, one for each row of `docs`.

    Words are counted in all documents that are not held out. `base_score` is the smoothed unigram score.
    `score` is the recurrent model's: ends and the most frequent words have outputs of their own; a rare word is its class
    times its share of that class, in which all unknown words are one symbol with the weight of the words seen
    once. A null or empty text is one end token; repeated rows are scored each, an empty table gives no rows.
    """
    rows = id_text(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held"), F.col("text").cast("binary").alias("data"))
    size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = int(max(16, size // BUCKET_BYTES))
    blocks = prepare(rows, buckets)
    counts = corpus_counts(blocks)
    sums = {bytes(r["word"]): r["c"] for r in counts.filter("kind = 1").groupBy("word").agg(F.sum("c").alias("c")).collect()}
    n, v, single, ends = (int(sums.get(k, 0)) for k in (b"tokens", b"distinct", b"single", b"ends"))
    top = counts.filter("kind = 2").orderBy(F.desc("c"), "word").limit(gru.FREQUENT).select("at", "place", "c").collect()  # the vocabulary
    weight = n - ends - sum(r["c"] for r in top) + single + 1
    texts = as_symbols(blocks, counts, {(r["at"], r["place"]): i for i, r in enumerate(top)}, n, v, single, weight)
    start = gru.initial(np.array([r["c"] for r in top]), ends, weight)
    model = fit(texts, start, n) if n else start
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of FREQUENT words and a state of fixed size
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        symbols, sizes = _symbols(rows.column("symbols"))
        score = np.add.reduceat(gru.score(sent.value, symbols, sizes), np.cumsum(sizes) - sizes) / np.log(10) + rows.column("inside").to_numpy()
        cols = [rows.column(k) for k in ("doc_id", "held", "n_tokens", "n_known")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(sizes), n, np.int64)), rows.column("base"), pa.array(score)], _names(schema))

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += pc.sum(b.column("n_tokens")).as_py() or 0
            if size >= SCORE_TOKENS:
                yield scored(pa.Table.from_batches(held))
                held, size = [], 0
        if sum(b.num_rows for b in held):
            yield scored(pa.Table.from_batches(held))

    return texts.select("doc_id", "held", "n_tokens", "n_known", "base", "inside", "symbols").mapInArrow(run, schema)
