"""Spelling variants of a corpus's words: pairs one code point apart, found through a dictionary of trie-node pairs.

Every word is cut at each of its positions. The part before a cut is a node of the trie of words, the part after
it a node of the trie of reversed words; nodes below which at least two words lie get integer numbers. A pair
(prefix node, suffix node) then names "anything here": words that skip one code point between the two nodes differ
in that code point alone, and a word without a gap between them lacks the code point that the others have there.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, ragged, release, slices, stored

#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Code points that a slice of the cutting job holds at most, a longer word aside.
CUT_CHARS = 1 << 18

_LETTERS = bytes(range(ord("a"), ord("z") + 1))
# In UTF-8 the letters U+00C0 to U+00FF are C3 and one more byte; A-Z become a-z.
_TO_WORDS = bytes(b if b in _LETTERS or b >= 0x80 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_PLAIN = bytes(range(0xC0)) + b"\xc3"
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def runs(text: bytes) -> list[bytes]:
    """Maximal runs of letters, with A-Z lower-cased."""
    if text.translate(None, _PLAIN):  # other letters and signs, whose last bytes look like those of U+00C0 to U+00FF
        return _RUN.findall(text.lower())
    return text.translate(_TO_WORDS).split()


def mistyped(run: bytes, h: int) -> bytes:
    """The run without its code point number h modulo its length."""
    s = run.decode()
    k = h % len(s)
    return (s[:k] + s[k + 1 :]).encode()


def count_words(docs: DataFrame, one_in: int = 97, min_len: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `word, n` of all words of at least `min_len` code points; a run loses a code point where `one_in` divides its hash with the id."""

    def run(batches):
        total: Counter = Counter()

        def out():
            words = [w for w in total if total[w] > 0 and len(w.decode()) >= min_len]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])

        for b in slices(batches):
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = [w for w in runs(text) if len(w) >= min_len]
                if not found:
                    continue
                total.update(found)
                own = list(set(found))
                seed = zlib.crc32(b":" if i is None else b"%d:" % i)
                h = np.fromiter(map(zlib.crc32, own, repeat(seed)), np.uint32, len(own))
                for k in np.flatnonzero(h % one_in == 0).tolist():
                    n = found.count(own[k])
                    total[own[k]] -= n
                    total[mistyped(own[k], int(h[k]))] += n
            if len(total) > COUNTED:
                yield out()
                total.clear()
        yield out()
        total.clear()
        release()

    return id_text(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Scatter 64-bit numbers (finalizer of a splittable generator)."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(place: np.ndarray, code: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """For each word and each cut 0..length: a sum over the code points before the cut, each scattered with its place."""
    x = _mix(_mix(place.astype(np.uint64), seed) ^ code.astype(np.uint64), seed + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return run[ragged(starts, lens + 1)] - np.repeat(run[starts], lens + 1)


def cut_words(words: DataFrame) -> DataFrame:
    """Rows `word_id, at, side, a, b, fresh`: of each word's cuts the nodes before (side 0) and after it (side 1).

    A node is known by 128 bits `a, b` of its code points and their places. `fresh` tells that the code
    point after the cut differs from the one before it. A word of L code points makes 2 (L + 1) rows.
    """

    def run(batches):
        for b in slices(batches, "word", CUT_CHARS):
            texts = b.column("word").to_pylist()
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            starts = np.cumsum(lens) - lens
            at = ragged(np.zeros(len(lens), np.int64), lens)
            cut = ragged(np.zeros(len(lens), np.int64), lens + 1)
            ids = np.repeat(b.column("word_id").to_numpy(), lens + 1)
            # Suffix nodes: the same sums over the reversed words, their cuts read backwards.
            mirror = np.repeat(starts + lens - 1, lens) - at
            flip = np.repeat(np.cumsum(lens + 1) - 1, lens + 1) - cut
            same = np.zeros(len(code), bool)
            same[1:] = code[1:] == code[:-1]
            fresh = np.ones(len(cut), bool)
            fresh[cut < np.repeat(lens, lens + 1)] = ~same | (at == 0)
            for side in (0, 1):
                own = [_sums(at, code[mirror] if side else code, starts, lens, 1000 * side + s) for s in (1, 3)]
                own = [(x[flip] if side else x).view(np.int64) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cut.astype(np.int32)), pa.array(np.full(len(cut), side, np.int8)), *map(pa.array, own), pa.array(fresh)], ["word_id", "at", "side", "a", "b", "fresh"])
        release()

    return words.select("word_id", "word").mapInArrow(run, "word_id long, at int, side byte, a long, b long, fresh boolean")


def node_pairs(words: DataFrame) -> DataFrame:
    """Rows `p, s, gap, word_id`: pairs of numbered nodes that a word has around a skipped code point (`gap` false) or around a cut.

    Nodes of one word alone can't bring it together with another and get no number. Of a run of equal code
    points only the first may count as inserted, so two words meet in one pair only; `fresh` marks it.
    """
    cuts = stored(cut_words(words), "word_cuts", "snappy")
    shared = cuts.groupBy("side", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("side", "a", "b")
    nodes = stored(shared, "trie_nodes", "snappy").withColumn("node", F.monotonically_increasing_id())
    placed = cuts.join(nodes, ["side", "a", "b"]).select("word_id", "at", "side", "node", "fresh")
    # The suffix after a cut stands beside the cut (kind 1) and, without the code point between, beside the cut before it (kind 2).
    kinds = F.when(F.col("side") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))
    beside = placed.withColumn("kind", F.explode(kinds)).withColumn("at", F.col("at") - (F.col("kind") == 2).cast("int"))
    node = lambda k: F.max(F.when(F.col("kind") == k, F.col("node")))
    both = beside.groupBy("word_id", "at").agg(node(0).alias("p"), node(1).alias("gap"), node(2).alias("skip"), F.max(F.when(F.col("kind") == 0, F.col("fresh"))).alias("fresh"))
    pair = F.explode(F.array(F.struct(F.lit(False).alias("gap"), F.col("skip").alias("s")), F.struct(F.lit(True).alias("gap"), F.col("gap").alias("s")))).alias("x")
    return both.filter("p IS NOT NULL").select("p", "word_id", "fresh", pair).select("p", "x.s", "x.gap", "fresh", "word_id").filter("s IS NOT NULL")


def near_words(words: DataFrame) -> DataFrame:
    """Rows `word_id, n_near, best`: of each word of `words` (`word_id, word`) with words one code point away, their number and the least id.

    Words of a pair that skip a code point differ in it, so a pair has as many as there are letters (90 here)
    and one without a gap: a bounded group.
    """
    groups = node_pairs(words).groupBy("p", "s").agg(
        F.sort_array(F.collect_list(F.when(~F.col("gap"), F.struct("word_id", "fresh")))).alias("m"), F.max(F.when(F.col("gap"), F.col("word_id"))).alias("short")
    ).filter(F.size("m") + F.col("short").isNotNull().cast("int") > 1)
    # Of the members that skip: the least, the second, and the same of those that may be taken for an insertion.
    first, second, longer = F.get("m", F.lit(0))["word_id"], F.get("m", F.lit(1))["word_id"], F.filter("m", lambda x: x["fresh"])
    skips = groups.select(F.size("m").alias("size"), first.alias("first"), second.alias("second"), "short", F.explode("m").alias("x")).select(
        F.col("x.word_id").alias("word_id"),
        (F.col("size") - 1 + (F.col("short").isNotNull() & F.col("x.fresh")).cast("int")).cast("long").alias("n_near"),
        F.least(F.when(F.col("x.word_id") == F.col("first"), F.col("second")).otherwise(F.col("first")), F.when(F.col("x.fresh"), F.col("short"))).alias("best"),
    )
    gaps = groups.filter("short IS NOT NULL").select(F.col("short").alias("word_id"), F.size(longer).cast("long").alias("n_near"), F.get(longer, F.lit(0))["word_id"].alias("best"))
    return skips.unionAll(gaps).filter("n_near > 0").groupBy("word_id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """Rows `word_id, root` of all links `word_id, form`: the last word reached, by doubling; links must lead to smaller ids."""
    now, left = stored(links.select("word_id", F.col("form").alias("root")), "roots", "snappy"), None
    while True:
        step = now.select(F.col("word_id").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(step, "root", "left").select("word_id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", "snappy")
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def variants(docs: DataFrame, min_len: int = 5, min_n: int = 3, ratio: int = 2, one_in: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `word, form, root, n, n_near, form_n` of every word of the corpus.

    Words are the runs of letters (`[A-Za-z\\u00C0-\\u00FF]+`, A-Z lower-cased, some mistyped as
    `count_words` says) of at least `min_len` code points that occur `min_n` times or more. Near words differ
    by one inserted, deleted or replaced code point. The form is the near word of largest n (ties: smallest in
    code-point order) if it has `ratio` times the word's n; the root is where forms lead to.

    A null or empty text has no words, a null id counts as empty text, repeated rows count each time, a run of
    letters of any length is one word, other columns are not read; an empty table gives no rows. Nodes are told
    apart by 128 bits, so results are exact up to collisions of these.
    """
    counted = count_words(docs, one_in, min_len, id_col, text_col).filter(F.col("n") >= min_n)
    # The order of ids is that of forms: larger n first, then the smaller word.
    words = stored(counted.orderBy(F.desc("n"), "word").withColumn("word_id", F.monotonically_increasing_id()), "words", "snappy")
    near = stored(near_words(words), "near_words", "snappy")
    best = words.select(F.col("word_id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    rows = words.join(near, "word_id", "left").join(best, "best", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    rows = stored(rows.select("word_id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(has, F.col(c)).alias(c) for c in ("best", "form", "form_n")]), "forms", "snappy")
    last = follow(rows.filter("best IS NOT NULL").select("word_id", F.col("best").alias("form")))
    names = words.select(F.col("word_id").alias("root_id"), F.col("word").alias("root"))
    rooted = rows.join(last.select("word_id", F.col("root").alias("root_id")), "word_id", "left").join(names, "root_id", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
