"""Suffix-array dedup: maximal repeats of a minimum length, from the interval tree of a sparse enhanced suffix array.

Suffixes are taken at anchors only: in every window of `LENGTH` bytes the position of the least hash of `GRAM`
bytes. Two equal windows choose the same anchor, so each repeat shows as two suffixes that share a prefix, with
equal bytes to their left. The suffixes of one anchor hash form a subtree of the suffix array; subtrees are
spread over the tasks. An anchor's context (all bytes that windows through it can reach) is first reduced to
distinct contexts, so copies meet in one row before any text is moved.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, ragged, release, slices, stored

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM  # bytes to the left of an anchor that a window through it can have
#: Anchors with more distinct contexts are settled by their windows' hashes instead of in one task.
CROWD = 20_000
PIECE = 1 << 20
_POS = np.uint64((1 << 28) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse, modulo 2^64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) <= n:
        base = _BASES[which]
        up, down = (np.cumprod(np.append(np.uint64(1), np.full(max(n, PIECE), b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
        _POWERS[which] = have = up, down
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any stretches of `data` from prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _powers(which, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[which][data] * up[: len(data)], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * self.down[lo])


def window_minima(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` neighbours, from running minima of blocks in both directions."""
    n = len(x) - size + 1
    grid = np.full(-(-len(x) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(x)] = x
    rows = grid.reshape(-1, size)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray):
    """Anchors of the texts that end at `ends` in `data`: (text, position in it, hash, context hash, bytes left, bytes right)."""
    starts = np.append(0, ends[:-1])
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none
    gram = Rolling(data, 0).all(GRAM)
    at = np.arange(len(gram), dtype=np.uint64)
    least = window_minima((gram & ~_POS) | (at & _POS), LENGTH - GRAM + 1)
    first = ragged(starts, np.maximum(ends - starts - LENGTH + 1, 0))  # starts of windows
    chosen = np.zeros(len(gram), bool)
    chosen[(least[first] & _POS).astype(np.int64)] = True
    pos = np.flatnonzero(chosen)
    text = np.searchsorted(ends, pos, side="right")
    left, right = np.minimum(REACH, pos - starts[text]), np.minimum(LENGTH, ends[text] - pos)
    context = _mix(Rolling(data, 1).of(pos - left, pos + right) ^ (left * 1009 + right).astype(np.uint64))
    return text, pos - starts[text], gram[pos], context, left, right


def long_anchors(data: np.ndarray):
    """The same for one text of any length, in overlapping pieces."""
    parts = []
    for a in range(0, len(data), PIECE):
        lo, hi = max(0, a - LENGTH), min(len(data), a + PIECE + 2 * LENGTH)
        _, pos, gram, context, left, right = anchors(data[lo:hi], np.array([hi - lo]))
        # An anchor is taken from the piece in which it lies: there its windows and context are whole.
        own = (pos + lo >= a) & (pos + lo < a + PIECE)
        parts.append([x[own] for x in (pos + lo, gram, context, left, right)])
    pos, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.zeros(len(pos), np.int64), pos, *rest


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text ends in them."""
    col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset).astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8, int(offsets[-1])) if offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


_FOUND = "_k long, _h long, pos int, l int, r int, n int, a long, c long"


def _anchor_rows(batches):
    """Anchors of each text; a context that a text has twice or more is settled here.

    Such a context is covered wherever it stands: its stretches go out as rows without `a` (from `pos`, `r` bytes),
    and one row with `n` = 2 stands for all of it. Periodic texts, whose anchors lie dense, shrink to few rows.
    """
    for b in slices(batches, "text", PIECE):
        data, ends = _bytes(b.column("text"))
        text, pos, gram, context, left, right = long_anchors(data) if len(ends) == 1 and len(data) > PIECE else anchors(data, ends)
        order = np.lexsort((context, gram, text))
        text, pos, gram, context, left, right = (x[order] for x in (text, pos, gram, context, left, right))
        fresh = np.append(True, (np.diff(text) != 0) | (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]))[: len(text)]
        size = np.diff(np.append(np.flatnonzero(fresh), len(text)))
        often = np.repeat(size > 1, size) & (left + right >= LENGTH)
        lo, hi, of = (pos - left)[often], (pos + right)[often], text[often]
        order = np.lexsort((lo, of))
        lo, hi, of = lo[order], hi[order], of[order]
        if len(lo):
            # Stretches of one text are merged where they touch (all have a context's length, so ends are in order too).
            reach = np.maximum.accumulate(hi + of * (int(hi.max()) + 1)) - of * (int(hi.max()) + 1)
            head = np.append(True, (of[1:] != of[:-1]) | (lo[1:] > reach[:-1]))
            first = np.flatnonzero(head)
            lo, hi, of = lo[first], np.maximum.reduceat(hi, first), of[first]
        none = [None] * len(lo)
        text, pos, gram, context, left, right = (x[fresh] for x in (text, pos, gram, context, left, right))
        for rows, where in (((pos, left, right, np.minimum(size, 2)), text), ((lo, 0 * lo, hi - lo, 0 * lo), of)):
            cols = [b.column(x).take(pa.array(where)) for x in ("_k", "_h")] + [pa.array(x.astype(np.int32)) for x in rows]
            cols += [pa.array(x.view(np.int64)) for x in (gram, context)] if where is text else [pa.array(none, pa.int64())] * 2
            if len(where):
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _FOUND.split(", ")])
    release()


def intervals(lcp: np.ndarray):
    """Nodes (depth, first, last) of the interval tree of a common-prefix array (`lcp[i]`: of rows i - 1 and i), by a stack."""
    stack, out = [(0, 0)], []
    for i in range(1, len(lcp) + 1):
        here, first = (int(lcp[i]) if i < len(lcp) else 0), i - 1
        while stack[-1][0] > here:
            depth, first = stack.pop()
            out.append((depth, first, i - 1))
        if stack[-1][0] < here:
            stack.append((here, first))
    return np.array(out, np.int64).reshape(-1, 3)


def _common(x: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows i and j of `x`, whose rows have `size` bytes."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 1 << 16):
        s = slice(a, a + (1 << 16))
        differ = x[i[s]] != x[j[s]]
        out[s] = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.minimum(out, np.minimum(size[i], size[j]))


def _sorted(x: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    words = x.view(">u8")
    return np.lexsort([*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), anchor])


class Contexts:
    """Distinct contexts of some anchors: right sides as sorted suffixes, left sides as reversed prefixes."""

    def __init__(self, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, text: list[bytes]):
        n, self.left, self.right = len(anchor), left, right
        self.rights, self.lefts = np.zeros((n, LENGTH), np.uint8), np.zeros((n, REACH), np.uint8)
        for i, t in enumerate(text):
            row = np.frombuffer(t, np.uint8) + np.uint8(1)  # UTF-8 has no byte 255; 0 ends a shorter side
            self.rights[i, : right[i]], self.lefts[i, : left[i]] = row[left[i] :], row[: left[i]][::-1]
        self.order = _sorted(self.rights, anchor)
        o = self.order
        lcp = _common(self.rights, o[:-1], o[1:], right) if n > 1 else np.zeros(0, np.int64)
        self.lcp = np.append(0, np.where(anchor[o[1:]] == anchor[o[:-1]], lcp, 0))[:n]
        self.rank = np.empty(n, np.int64)
        self.rank[_sorted(self.lefts, anchor)] = np.arange(n)

    def repeats(self, at_once: int = 1 << 18):
        """Batches (group, context, bytes left, bytes right, group's bytes left) of left-diverse groups of repeats.

        In each interval the left sides are put in order; runs of neighbours that share enough to make up the
        length are the groups, each as long to the left as all of it agrees.
        """
        nodes = intervals(self.lcp)
        nodes = nodes[nodes[:, 0] >= LENGTH - REACH]
        size = nodes[:, 2] - nodes[:, 1] + 1
        edges = np.flatnonzero(np.diff(np.cumsum(size) // at_once)) + 1
        for part in np.split(np.arange(len(nodes)), edges):
            if not len(part):
                continue
            node = np.repeat(part, size[part])
            member = self.order[ragged(nodes[part, 1], size[part])]
            by = np.lexsort((self.rank[member], node))
            node, member = node[by], member[by]
            depth = nodes[node, 0]
            same = np.append(False, node[1:] == node[:-1])
            shared = np.zeros(len(node), np.int64)
            k = np.flatnonzero(same)
            shared[k] = _common(self.lefts, member[k - 1], member[k], self.left)
            joined = same & (shared + depth >= LENGTH)
            group = np.cumsum(~joined)
            after = np.append(joined[1:], False)
            keep = joined | after
            best = np.maximum(np.where(joined, shared, 0), np.where(after, np.append(shared[1:], 0), 0))
            least = np.full(group[-1] + 1, REACH, np.int64)
            np.minimum.at(least, group[joined], shared[joined])
            yield group[keep], member[keep], best[keep], depth[keep], least[group[keep]]


_MOVED = "kind int, key long, a long, c long, l int, r int, ctx binary"


def _context_rows(batches, text_col):
    """Contexts of the wanted anchors of each text; those of crowded anchors as hashed windows.

    Kinds: 0 a context (l, r: its bytes left and right), 1 a window (l, r: of the anchor), 2 a verdict. A crowded
    window seen twice in a batch is settled there, and only one row of it goes on.
    """
    names = [x.split()[0] for x in _MOVED.split(", ")]
    for batch in batches:
        for b in slices(iter([batch]), text_col, PIECE):
            data, ends = _bytes(b.column(text_col).cast(pa.string()))
            starts = ends - np.append(ends[:1], np.diff(ends))
            want = b.column("_want")
            flat, count = want.flatten(), pc.list_value_length(want).to_numpy()
            a, c, pos, left, right, big = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("a", "c", "pos", "l", "r", "big"))
            at = np.repeat(starts, count) + pos
            k = np.flatnonzero(~big)
            if len(k):
                text = [data[i - x : i + y].tobytes() for i, x, y in zip(at[k], left[k], right[k], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k), np.int32)), *(pa.array(x[k]) for x in (a, a, c, left, right)), pa.array(text, pa.binary())], names)
            k = np.flatnonzero(big)
            if len(k):
                lo, hi = np.maximum(0, LENGTH - right[k]), left[k]  # offsets of the anchor in its windows
                n = np.maximum(hi - lo + 1, 0)
                who = np.repeat(k, n)
                off = ragged(lo.astype(np.int64), n.astype(np.int64))
                begin = at[who] - off
                h = [Rolling(data, w).of(begin, begin + LENGTH) for w in (0, 1)]
                key = _mix(h[0] ^ a[who].view(np.uint64) ^ off.astype(np.uint64))
                order = np.lexsort((h[1], h[0], off, a[who]))
                who, off, key, h = who[order], off[order], key[order], [x[order] for x in h]
                same = (np.diff(a[who]) == 0) & (np.diff(off) == 0) & (np.diff(h[0]) == 0) & (np.diff(h[1]) == 0)
                again, twice = np.append(False, same), np.append(False, same) | np.append(same, False)
                digest = np.stack(h, axis=1)
                for kind, use in ((1, ~again), (2, twice)):
                    w = who[use]
                    if len(w):
                        ctx = pa.array([x.tobytes() for x in digest[use]], pa.binary()) if kind == 1 else pa.nulls(len(w), pa.binary())
                        cols = [np.full(len(w), kind, np.int32), key[use].view(np.int64), a[w], c[w], off[use].astype(np.int32), (LENGTH - off[use]).astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), ctx], names)


def _verdict_rows(batches):
    """How far each distinct context is repeated to the left and right of its anchor: `a, c, l, r`."""
    table = pa.Table.from_batches([b for b in batches if b.num_rows], schema=_MOVED_ARROW)
    kind, a, c, l, r = (table.column(x).to_numpy() for x in ("kind", "a", "c", "l", "r"))
    out = [(a[kind == 2], c[kind == 2], l[kind == 2], r[kind == 2])]
    k = np.flatnonzero(kind == 0)
    if len(k):
        own = Contexts(a[k], l[k].astype(np.int64), r[k].astype(np.int64), table.column("ctx").take(pa.array(k)).to_pylist())
        for _, member, left, right, _ in own.repeats():
            out.append((a[k][member], c[k][member], left, right))
    k = np.flatnonzero(kind == 1)
    if len(k):
        digest = np.frombuffer(b"".join(table.column("ctx").take(pa.array(k)).to_pylist()), np.uint64).reshape(-1, 2)
        order = np.lexsort((digest[:, 1], digest[:, 0], l[k], a[k]))
        k, digest = k[order], digest[order]
        same = (np.diff(a[k]) == 0) & (np.diff(l[k]) == 0) & (np.diff(digest, axis=0) == 0).all(axis=1)
        k = k[np.append(False, same) | np.append(same, False)]
        out.append((a[k], c[k], l[k], r[k]))
    a, c, l, r = (np.concatenate([np.asarray(x, np.int64) for x in col]) for col in zip(*out, strict=True))
    if len(a):
        # One row for each context.
        order = np.lexsort((c, a))
        a, c, l, r = a[order], c[order], l[order], r[order]
        first = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(c) != 0)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], c[first], np.maximum.reduceat(l, first), np.maximum.reduceat(r, first))], ["a", "c", "l", "r"])


_MOVED_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("c", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("ctx", pa.binary())])


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """`docs` plus `_spans`: array of (lo, hi), not merged, whose union are the bytes covered by repeats.

    Rows are told apart by id and text; equal rows are occurrences of each other. All passes share one shuffle
    of the texts, and only anchors whose hash occurs twice ever leave the task that found them as rows with text.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-1)).alias("_k"), F.xxhash64(F.col(f"`{id_col}`").cast("long"), text).alias("_h")]
    found = stored(docs.select(*key, text.alias("text")).mapInArrow(_anchor_rows, _FOUND), "anchors")
    local = found.filter("a IS NULL").select("_k", "_h", F.struct(F.col("pos").cast("long").alias("lo"), (F.col("pos") + F.col("r")).cast("long").alias("hi")).alias("s"))
    found = found.filter("a IS NOT NULL")
    # A second key column keeps the aggregation's partitioning from serving the join, whose hot keys can then be split.
    more = found.groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1").select("a", F.bitwise_not("a").alias("a2"))
    again = stored(found.withColumn("a2", F.bitwise_not("a")).join(more, ["a", "a2"], "left_semi").drop("a2"), "repeated")
    classes = again.groupBy("a", "c").agg(F.sum("n").alias("n"), *[F.first(x).alias(x) for x in ("_k", "_h", "pos", "l", "r")])
    per_anchor = classes.groupBy("a").agg(F.count(F.lit(1)).alias("m")).withColumn("a2", F.bitwise_not("a"))
    classes = stored(classes.withColumn("a2", F.bitwise_not("a")).join(per_anchor, ["a", "a2"]).drop("a2"), "contexts")

    base = docs.select("*", *key)
    want = classes.filter("m > 1").select("_k", "_h", F.struct("a", "c", "pos", "l", "r", (F.col("m") > crowd).alias("big")).alias("w"))
    want = want.groupBy("_k", "_h").agg(F.collect_list("w").alias("_want"))  # at most the anchors of one text
    # All columns go to Python, so that both joins with the texts can use one shuffle of them.
    moved = base.join(want, ["_k", "_h"]).mapInArrow(lambda batches: _context_rows(batches, text_col), _MOVED)
    tree = moved.repartition("key").mapInArrow(_verdict_rows, "a long, c long, l long, r long")
    whole = classes.filter((F.col("n") > 1) & (F.col("l") + F.col("r") >= LENGTH)).select("a", "c", F.col("l").cast("long"), F.col("r").cast("long"))
    verdict = whole.unionAll(tree).groupBy("a", "c").agg(F.max("l").alias("vl"), F.max("r").alias("vr")).withColumn("a2", F.bitwise_not("a"))
    spans = again.withColumn("a2", F.bitwise_not("a")).join(verdict, ["a", "c", "a2"]).select("_k", "_h", F.struct((F.col("pos") - F.col("vl")).alias("lo"), (F.col("pos") + F.col("vr")).alias("hi")).alias("s"))
    spans = spans.unionAll(local).groupBy("_k", "_h").agg(F.collect_list("s").alias("_spans"))  # at most the anchors of one text
    return base.join(spans, ["_k", "_h"], "left").drop("_k", "_h")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal stretches of the union."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:bigint,hi:bigint>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Rows `doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`: what is left without bytes covered by a repeat.

    A repeat is a string of 200 bytes that also starts anywhere else, in any document or the same one; overlaps
    count. A null or short text keeps all it has, repeated rows cover each other, extra columns are ignored and
    an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in slices(batches):
            rows = []
            for doc, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("_spans").to_pylist(), strict=True):
                text, cut = text or b"", merged(spans)
                kept = kept_bytes(text, cut)
                rows.append((doc, len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [{"lo": x, "hi": y} for x, y in cut]))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return with_spans(named, crowd=crowd).select("doc_id", F.col("text").cast("string").alias("text"), "_spans").mapInArrow(run, _OUT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with repeats cut out of `text` (half-cut characters go too), and `n_chars`, if there, counted again."""
    own = apart(docs, ("doc_id", "text", "n_chars"))
    df = with_spans(own)
    names = own.columns

    def run(batches):
        for b in slices(batches):
            out = []
            for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("_spans").to_pylist(), strict=True):
                out.append(kept_bytes(text, merged(spans)).decode(errors="ignore") if spans and text is not None else None if text is None else text.decode())
            cols = [pa.array(out, pa.string()) if n == "text" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    cut = df.mapInArrow(run, T.StructType(own.schema.fields))
    cut = cut.withColumn("n_chars", F.length("text").cast(own.schema["n_chars"].dataType)) if "n_chars" in names else cut
    return cut.toDF(*docs.columns)
