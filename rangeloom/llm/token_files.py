"""Token-ID files: Simple-8b word-aligned coding of ids, written in document order and read back.

A file set is a Parquet folder of segments. A segment row holds whole documents: `part, seq` (order), `first`
(ids of its part before it), `n_ids`, `doc_ids`, `sizes` (ids per document) and `payload`, which is

    4 bytes   magic `S8B1`
    u32       ids per block, u32 number of blocks, u64 number of ids
    u32[...]  index of the first word of every block (blocks decode on their own)
    u64[...]  words, little-endian: the top 4 bits select how many ids of how many bits follow in the low 60

Selector 0 is the escape: the next word is one id of up to 64 bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, slices
from .words import library_ids

#: Ids per word and bits per id of selectors 1 to 15.
COUNTS = np.array([0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BLOCK = 4096
SEGMENT_IDS = 1 << 20
_MAGIC = b"S8B1"
_STEP = np.where(COUNTS == 0, 1, COUNTS)
_WIDTH16 = np.concatenate([[0], np.floor(np.log2(np.arange(1, 1 << 16))).astype(np.int64) + 1]).astype(np.uint8)


def bit_widths(ids: np.ndarray) -> np.ndarray:
    """Bits of every id (0 for id 0)."""
    ids = ids.astype(np.uint64)
    out = _WIDTH16[ids.astype(np.uint16)]
    top = int(ids.max(initial=0))
    for shift in (s for s in (16, 32, 48) if top >> s):
        part = ((ids >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
        out = np.where(part > 0, _WIDTH16[part] + np.uint8(shift), out)
    return out


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Ids (up to 64 bits each) as one payload."""
    ids = np.asarray(ids).astype(np.uint64)
    n, n_blocks = len(ids), -(-len(ids) // block)
    width = np.zeros(n_blocks * block, np.uint8)
    width[:n] = bit_widths(ids)
    grid = width.reshape(n_blocks, block)
    # widest[i]: largest width among the next c ids of the block; ids past its end need no bits.
    pick = np.zeros((n_blocks, block), np.uint8)
    widest, have = grid, 1
    for sel in range(15, 0, -1):
        want = int(COUNTS[sel])
        while have < want:
            step = min(have, want - have)
            grown = widest.copy()
            if step < block:
                np.maximum(widest[:, :-step], widest[:, step:], out=grown[:, :-step])
            widest, have = grown, have + step
        pick[widest <= BITS[sel]] = sel
    pick = pick.ravel()
    # All blocks advance together, a word at a time.
    at, end = np.arange(n_blocks, dtype=np.int64) * block, np.minimum(np.arange(1, n_blocks + 1) * block, n)
    begins = np.zeros(n_blocks * block, bool)
    while len(at):
        begins[at] = True
        at = at + _STEP[pick[at]]
        if (live := at < end).all():
            continue
        at, end = at[live], end[live]
    start = np.flatnonzero(begins)
    end = np.minimum(np.arange(1, n_blocks + 1) * block, n)
    sel = pick[start].astype(np.int64)
    stop = np.minimum(np.append(start[1:], n), end[start // block]) if len(start) else start
    held = stop - start
    slot = np.repeat(np.arange(len(start)), held)
    shift = ((np.arange(n) - start[slot]) * BITS[sel][slot]).astype(np.uint64)
    body = np.bitwise_or.reduceat(np.where(sel[slot] == 0, np.uint64(0), ids) << shift, start) if n else np.zeros(0, np.uint64)
    word = body | (sel.astype(np.uint64) << np.uint64(60))
    place = np.cumsum(np.where(sel == 0, 2, 1)) - np.where(sel == 0, 2, 1)
    words = np.zeros(int(place[-1]) + (2 if sel[-1] == 0 else 1) if n else 0, "<u8")
    words[place] = word
    words[place[sel == 0] + 1] = ids[start[sel == 0]]
    first = place[np.searchsorted(start, np.arange(n_blocks) * block)].astype("<u4")
    return _MAGIC + struct.pack("<IIQ", block, n_blocks, n) + first.tobytes() + words.tobytes()


def decode_ids(payload: bytes) -> np.ndarray:
    """The ids of a payload, as unsigned 64-bit numbers."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a Simple-8b payload")
    block, n_blocks, n = struct.unpack_from("<IIQ", payload, 4)
    first = np.frombuffer(payload, "<u4", n_blocks, 20).astype(np.int64)
    words = np.frombuffer(payload, "<u8", -1, 20 + 4 * n_blocks).astype(np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == 0).any():
        # A word after an escape is an id: walk the blocks together, since it may look like anything.
        at, end = first.copy(), np.append(first[1:], len(words))
        while (live := at < end).any():
            here = at[live]
            escaped = here[sel[here] == 0]
            raw[escaped + 1] = True
            at[live] = here + np.where(sel[here] == 0, 2, 1)
    head = np.flatnonzero(~raw)
    held = np.where(sel[head] == 0, 1, COUNTS[sel[head]])
    # The last word of a block holds what is left of it.
    of = np.searchsorted(first, head, side="right") - 1
    ends = np.cumsum(held)
    last = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(head) else np.zeros(0, np.int64)
    total = np.diff(np.concatenate([[0], ends[last]]))
    held[last] -= total - np.minimum(block, n - block * np.arange(n_blocks))
    start = np.cumsum(held) - held
    slot = np.repeat(np.arange(len(head)), held)
    bits = BITS[sel[head]]
    shift = ((np.arange(n) - start[slot]) * bits[slot]).astype(np.uint64)
    mask = (np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1)
    out = (words[head][slot] >> shift) & mask[slot]
    lone = np.flatnonzero(sel[head] == 0)
    out[start[lone]] = words[head[lone] + 1]
    return out


_SEGMENT = "part int, seq int, first long, n_ids long, doc_ids array<bigint>, sizes array<bigint>, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append `end_id` to each, and write the ids in ascending order of id as segments.

    A null text is empty (its only id is `end_id`), a null id sorts first, repeated rows are all written
    (rows of one id in the order of their texts); an empty table gives a readable folder without segments.
    Rows are dealt by ranges of id, so parts and rows in them follow the order.
    """

    def run(batches):
        encode, part = library_ids(tokenizer, True), TaskContext.get().partitionId()
        seq, first = 0, 0
        for b in slices(batches):
            ids, sizes = encode(b.column("text").to_pylist())
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id)
            sizes = sizes + 1
            cut = np.cumsum(sizes)
            group = (cut - sizes) // SEGMENT_IDS
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                own = ids[cut[lo] - sizes[lo] : cut[hi - 1]]
                row = [part, seq, first, len(own), b.column("doc_id").slice(lo, hi - lo), sizes[lo:hi], encode_ids(own)]
                cols = [pa.array([v], t) for v, t in zip(row[:4], (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                cols += [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.array(v, pa.int64())) for v in row[4:6]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([row[6]], pa.binary())], ["part", "seq", "first", "n_ids", "doc_ids", "sizes", "payload"])
                seq, first = seq + 1, first + len(own)

    rows = id_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    rows.mapInArrow(run, _SEGMENT).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Rows `doc_id, start, n_tokens, ids_crc32` and, if asked, `ids` (array) of every document of a file set.

    `start` counts the ids of all documents before it; `ids_crc32` is over its ids as little-endian 32-bit numbers.
    """
    seg = spark.read.schema(_SEGMENT).parquet(path)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per written part, so the window and the broadcast are bounded by the number of tasks that wrote.
    parts = seg.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = seg.join(F.broadcast(parts), "part").select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "sizes", "payload")

    def run(batches):
        for b in batches:
            for start, docs, sizes, payload in zip(b.column("start").to_pylist(), b.column("doc_ids"), b.column("sizes"), b.column("payload"), strict=True):
                ids = decode_ids(payload.as_py()).astype("<u4")
                n = sizes.values.to_numpy()
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends, n, strict=True)]
                cols = [docs.values, pa.array(start + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids)
