"""Packing by cutting stock: column generation over the histogram of lengths, patterns assigned to ranked documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, release, slices, stored, stored_few
from .words import word_ids

CAPACITY, UNIT = 4096, 16
BROADCAST_BYTES = 32 << 20
#: Text encoded in one go.
ENCODE_BYTES = 6 << 20


def best_pattern(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: pieces of 1..room units worth `value[1..room]`."""
    best, took = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for w in range(1, room + 1):
        got = value[1 : w + 1] + best[w - 1 :: -1]
        k = int(got.argmax())
        best[w], took[w] = (got[k], k + 1) if got[k] > best[w - 1] + 1e-12 else (best[w - 1], 0)
    counts, w = np.zeros(room + 1, np.int64), room
    while w > 0:
        counts[took[w]] += took[w] > 0
        w -= max(int(took[w]), 1)
    return float(best[room]), counts


def cutting_stock(demand: np.ndarray, room: int, rounds: int = 4000, gap: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: pieces of each size) and how often to use each, for `demand[size]` pieces of 1..room-1 units.

    Revised simplex on  min sum(x), patterns @ x = demand: columns are priced by the knapsack until none
    improves, Farley's bound is within `gap`, or `rounds` columns have entered (every basis is feasible). The
    counts are rounded down, then raised while the remaining demand holds a whole pattern.
    """
    sizes = np.flatnonzero(demand)
    m = len(sizes)
    if not m:
        return np.zeros((0, room + 1), np.int64), np.zeros(0, np.int64)
    basis = np.diag(room // sizes).astype(float)  # a column per pattern
    inverse, x = np.diag(1.0 / np.diag(basis)), demand[sizes] / np.diag(basis)
    for k in range(rounds):
        dual = inverse.sum(axis=0)
        value = np.full(room + 1, -1.0)
        value[sizes] = dual
        best, pattern = best_pattern(value, room)
        if best <= 1 + 1e-9 or float(dual @ demand[sizes]) / best >= (1 - gap) * x.sum():
            break
        column = pattern[sizes].astype(float)
        move = inverse @ column
        ratio = np.where(move > 1e-9, np.maximum(x, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        if k % 100 == 99:
            inverse = np.linalg.inv(basis)
            x = inverse @ demand[sizes]
        else:
            row = inverse[out] / move[out]
            x = x - move * ratio[out]
            x[out] = ratio[out]
            inverse = inverse - np.outer(move, row)
            inverse[out] = row
    patterns = np.zeros((m, room + 1), np.int64)
    patterns[:, sizes] = np.rint(basis.T).astype(np.int64)
    times = np.floor(np.maximum(x, 0) + 1e-6).astype(np.int64)
    left = demand - times @ patterns
    while (left < 0).any():  # rounding noise of a nearly whole count
        worst = int(np.argmax((patterns[:, left < 0] > 0).any(axis=1) * times))
        times[worst] -= 1
        left = left + patterns[worst]
    order = np.argsort(-(x - times), kind="stable")
    for p in order:
        use = patterns[p] > 0
        extra = int((left[use] // patterns[p][use]).min()) if use.any() else 0
        times[p] += extra
        left = left - extra * patterns[p]
    keep = times > 0
    return patterns[keep], times[keep]


class Plan:
    """Places of pieces by size and rank: whole sequences of the patterns, then one stream for what is left.

    The stream takes the ranks beyond the patterns' demand and the document ends shorter than a unit, and is
    cut at the capacity; its last part is cut into powers of two, which need no padding.
    """

    def __init__(self, demand: np.ndarray, tails: int, fulls: int, capacity: int = CAPACITY, unit: int = UNIT):
        self.capacity, self.unit, room = capacity, unit, capacity // unit
        patterns, times = cutting_stock(demand, room)
        first = np.cumsum(times) - times
        within = (np.cumsum(patterns * np.arange(room + 1), axis=1) - patterns * np.arange(room + 1)) * unit
        self.full_seq = int(times.sum())
        self.stream_seq = self.full_seq + fulls
        #: by size: first rank, pieces per sequence, first sequence and offset of each pattern that holds the size
        self.by_size, self.planned, self.stream_at = {}, np.zeros(room + 1, np.int64), np.zeros(room + 1, np.int64)
        for c in np.flatnonzero(demand):
            p = np.flatnonzero(patterns[:, c])
            n = patterns[p, c] * times[p]
            self.by_size[int(c)] = (np.cumsum(n) - n, patterns[p, c], first[p], within[p, c])
            self.planned[c] = n.sum()
        rest = (demand - self.planned) * np.arange(room + 1) * unit
        self.stream_at = np.cumsum(rest) - rest
        self.tail_at = int(rest.sum())
        total = self.tail_at + tails
        edge, ends = total // capacity * capacity, []
        for k in range(capacity.bit_length() - 1, -1, -1):
            if (total - edge) >> k & 1:
                ends.append((ends[-1] if ends else edge) + (1 << k))
        self.edge, self.ends = edge, np.array(ends, np.int64)

    def stream(self, at: int, length: int) -> list[tuple[int, int, int, int]]:
        """(shift in the piece, length, sequence, offset) of a stretch of the stream."""
        out, pos = [], at
        while pos < at + length:
            if pos < self.edge:
                k, lo = pos // self.capacity, pos // self.capacity * self.capacity
                hi = lo + self.capacity
            else:
                j = int(np.searchsorted(self.ends, pos, side="right"))
                k, lo, hi = self.edge // self.capacity + j, int(self.ends[j - 1]) if j else self.edge, int(self.ends[j])
            n = min(hi, at + length) - pos
            out.append((pos - at, n, self.stream_seq + k, pos - lo))
            pos += n
        return out

    def place(self, c: int, rank: int) -> list[tuple[int, int, int, int]]:
        if rank >= self.planned[c]:
            return self.stream(int(self.stream_at[c] + (rank - self.planned[c]) * c * self.unit), c * self.unit)
        start, per, seq, off = self.by_size[c]
        e = int(np.searchsorted(start, rank, side="right")) - 1
        q, s = divmod(rank - int(start[e]), int(per[e]))
        return [(0, c * self.unit, int(seq[e]) + q, int(off[e]) + s * c * self.unit)]


_ROWS = "part int, doc_id long, n long, size int, rank long, fulls long, tails long, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces `doc_id, start, length, doc_tokens, sequence_id, offset, ids` of all documents (null text: empty).

    Texts are encoded once and stored with their number among the documents of the same length class of their
    part. Only the histogram (capacity / unit classes) reaches the driver, which solves the cutting-stock
    program; a document's global rank in its class then gives its place, so ids are never shuffled.
    A document of more than `capacity` ids fills whole sequences first; its remainder is a main piece of
    whole units, and an end of less than a unit. `ids` holds little-endian unsigned 32-bit ids. Repeated
    rows are packed each; an empty table gives no pieces. Documents need no ids of their own: a null id stays null.
    """
    if capacity % unit or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two and a multiple of unit")

    def encode(batches):
        ids_of, part = word_ids(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity // unit, np.int64)
        fulls = tails = 0
        for b in slices(batches, limit=ENCODE_BYTES):
            ids, n = ids_of(b.column("text"))
            ids = np.insert(ids, np.cumsum(n), end_id)
            n = n + 1
            size, full, tail = n % capacity // unit, n // capacity, n % unit
            order = np.argsort(size, kind="stable")
            count = np.bincount(size, minlength=len(seen))
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
            seen += count
            cols = [np.full(len(n), part), b.column("doc_id"), n, size, rank, fulls + np.cumsum(full) - full, tails + np.cumsum(tail) - tail]
            fulls, tails = fulls + int(full.sum()), tails + int(tail.sum())
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            ends = np.append(0, np.cumsum(n) * 4)
            binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([*(pa.array(v, t) if isinstance(v, np.ndarray) else v for v, t in zip(cols, kinds, strict=True)), binary], [x.split()[0] for x in _ROWS.split(", ")])
            del ids, binary
        release()

    rows = stored(id_text(docs, id_col, text_col).mapInArrow(encode, _ROWS), "ids")
    counts = rows.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n") / capacity)).alias("fulls"), F.sum(F.col("n") % unit).alias("tails"))
    n_parts = rows.select("part").distinct().count()
    counts = stored_few(counts, "counts", n_parts * (capacity // unit))
    histogram = counts.groupBy("size").agg(F.sum("n").alias("n"), F.sum("fulls").alias("fulls"), F.sum("tails").alias("tails")).collect()
    demand = np.zeros(capacity // unit + 1, np.int64)
    for r in histogram:
        demand[r["size"]] += r["n"] if r["size"] else 0
    plan = Plan(demand, sum(r["tails"] for r in histogram), sum(r["fulls"] for r in histogram), capacity, unit)

    # Of every part, what comes before it: ranks by size, whole sequences, ends. The windows run over parts.
    earlier = lambda *by: W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranks = counts.select("part", "size", F.coalesce(F.sum("n").over(earlier("size")), F.lit(0)).alias("before"))
    ranks = ranks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("size", "before"))).alias("ranks_before"))
    sums = counts.groupBy("part").agg(F.sum("fulls").alias("f"), F.sum("tails").alias("t"))
    sums = sums.select("part", *[F.coalesce(F.sum(c).over(earlier(F.lit(0))), F.lit(0)).alias(name) for c, name in (("f", "fulls_before"), ("t", "tails_before"))])
    offsets = ranks.join(sums, "part")
    if n_parts * (capacity // unit) * 16 <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    at = F.col("rank") + F.element_at("ranks_before", F.col("size"))
    placed = rows.join(offsets, "part").select("doc_id", "n", "size", at.alias("rank"), (F.col("fulls") + F.col("fulls_before")).alias("fulls"), (F.col("tails") + F.col("tails_before")).alias("tails"), "ids")

    def pieces(batches):
        for batch in batches:
            for b in slices(iter([batch]), "ids", 16 << 20):
                out, data = [], []
                for doc, n, c, rank, fulls, tails, ids in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    full, at = n // capacity, n // capacity * capacity
                    own = [(i * capacity, capacity, plan.full_seq + fulls + i, 0) for i in range(full)]
                    if c:
                        own += [(at + s, k, seq, off) for s, k, seq, off in plan.place(c, rank)]
                    at += c * unit
                    own += [(at + s, k, seq, off) for s, k, seq, off in plan.stream(plan.tail_at + tails, n % unit)]
                    out += [(doc, s, k, n, seq, off) for s, k, seq, off in own]
                    data += [ids[4 * s : 4 * (s + k)] for s, k, _, _ in own]
                cols = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(data, pa.binary())], [x.split()[0] for x in _PIECES.split(", ")])

    return placed.mapInArrow(pieces, _PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
