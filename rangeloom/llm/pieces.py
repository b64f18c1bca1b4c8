"""SentencePiece encoding by a batched Viterbi search in numpy, and decoding.

Words are cut at the space mark; words of equal length advance together, a character at a time. Every substring's
hash probes the sorted keys of the pieces; per end position the best score and its piece's length are kept.
The result is the segmentation of highest total score, as the library gives it for a unigram model with these
pieces and scores; sums are in double precision over each word, where the library rounds its running sum over the
whole text to single precision.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, ragged, slices
from .words import Ids

MARK = "▁"
UNKNOWN_COST = 10.0  # below the least score, as in the library
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bounds of a search step (words, and cells of their table) and of a decoding step.
ROWS_AT_ONCE, CELLS_AT_ONCE, IDS_AT_ONCE = 1 << 15, 1 << 20, 1 << 19


class Pieces:
    """Pieces of one model file: sorted keys, scores, bytes, and the normaliser of the library."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_ids = np.zeros(256, np.uint32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(names[i][1:-1], 16)] = i
        self.fallback, self.unknown = bool(self.byte_ids.any()), sp.unk_id()
        self.longest = max(len(names[i]) for i in plain)
        if any(MARK in names[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a space mark after other characters: words can't be cut at it")
        # A character of no piece stands alone in every segmentation; line ends are the common case.
        alone = "\n" if not any("\n" in names[i] for i in plain) else ""
        self.word = re.compile(f"{alone}|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        score = np.array([sp.get_score(i) for i in plain])
        self.least = score.min() - UNKNOWN_COST
        key = np.array([self.key(np.array([[ord(c) for c in names[i]]], np.uint64))[0] for i in plain], np.uint64)
        order = np.argsort(key)
        self.keys, self.ids, self.scores = key[order], np.array(plain, np.uint32)[order], score[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        #: what each id decodes to; control and unknown ids are empty
        texts = [bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.text_size = np.array([len(t) for t in texts], np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.known = Ids(self.fill, limit=400_000, keep=150_000)

    @staticmethod
    def key(codes: np.ndarray) -> np.ndarray:
        """Hash of each row of code points."""
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = h * _BASE + codes[:, j] + np.uint64(1)
        return h ^ (h >> np.uint64(29))

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the keys, and whether it is one of them."""
        h = h ^ (h >> np.uint64(29))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words of equal length (rows of code points): piece length and key place (-1: unknown) for every end position."""
        n, size = codes.shape
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        took, place = np.zeros((size + 1, n), np.int64), np.full((size + 1, n), -1, np.int64)
        # Running hashes of the substrings that start at each place; they grow by one character a step.
        sums = np.zeros((size, n), np.uint64)
        for j in range(1, size + 1):
            lo = max(0, j - self.longest)
            sums[lo:j] = sums[lo:j] * _BASE + codes[:, j - 1] + np.uint64(1)
            at, hit = self.probe(sums[lo:j])
            # Longer pieces come first, and only a higher score replaces them.
            got = np.where(hit, best[lo:j] + self.scores[at], -np.inf)
            pick = got.argmax(axis=0)
            cols = np.arange(n)
            best[j], took[j], place[j] = got[pick, cols], j - lo - pick, at[pick, cols]
            alone = ~hit[-1]
            instead = alone & (best[j - 1] + self.least > best[j])
            best[j][instead], took[j][instead], place[j][instead] = (best[j - 1] + self.least)[instead], 1, -1
        return took, place

    def fill(self, new: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(new)
        size = np.fromiter(map(len, new), np.int64, len(new))
        order = np.argsort(size, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            length = int(size[part[0]]) if len(part) else 0
            rows = max(1, min(ROWS_AT_ONCE, CELLS_AT_ONCE // max(1, length)))
            for a in range(0, len(part), rows):
                own = part[a : a + rows]
                codes = np.frombuffer("".join([new[i] for i in own]).encode("utf-32-le"), np.uint32).reshape(len(own), length).astype(np.uint64)
                took, place = self.viterbi(codes)
                ids = np.where(place >= 0, self.ids[place], self.unknown).astype(np.uint32)
                self.trace(codes, took, place, ids, own, out)
        return out

    def trace(self, codes, took, place, ids, own, out) -> None:
        """Follow the backpointers of all words together, from the ends."""
        n, size = codes.shape
        at, marks = np.full(n, size), np.zeros((size + 1, n), bool)
        while (live := at > 0).any():
            k = np.flatnonzero(live)
            marks[at[k], k] = True
            at[k] -= took[at[k], k]
        word, end = np.nonzero(marks.T)
        cuts = np.searchsorted(word, np.arange(n + 1))
        flat, unknown = ids[end, word], place[end, word] < 0
        for w, i in enumerate(own):
            s = slice(cuts[w], cuts[w + 1])
            row = flat[s]
            if self.fallback and unknown[s].any():
                row = np.concatenate([self.byte_ids[list(chr(int(codes[w, e - 1])).encode())] if u else [x] for x, u, e in zip(row, unknown[s], end[s], strict=True)])
            out[i] = row

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the number of ids of each."""
        return self.known.encode([self.word.findall(t) for t in self.sp.normalize(texts)])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of runs of ids: pieces joined, space marks as spaces, the one before the first word taken off."""
        ids = ids.astype(np.int64)
        n = self.text_size[ids]
        data = self.text[ragged(self.text_start[ids], n)].tobytes()
        ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(sizes))]
        return [data[a + (data[a : a + 1] == b" " and a < b) : b].decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    """One table per model and Python worker."""
    return Pieces(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, ids` (array), one for each row of `docs`; a null or empty text has no ids."""

    def run(batches):
        p = pieces(model)
        for b in slices(batches):
            ids, sizes = p.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """Rows `doc_id, ids, text` of rows `doc_id, ids`; null ids decode to the empty text."""

    def run(batches):
        p = pieces(model)
        for b in batches:
            col = b.column("ids")
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(sizes) - sizes) // IDS_AT_ONCE
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own = col.slice(lo, hi - lo)
                text = p.decode(own.flatten().to_numpy(zero_copy_only=False), sizes[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), own, pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")
