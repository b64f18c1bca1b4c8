"""Token counts: byte-pair merging with a heap of pairs over a linked list; only the number of tokens is kept."""

from __future__ import annotations

import functools
import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices
from .words import Numbers, chunks

# The pre-token pattern of the byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class MergeCounter:
    """Counts tokens of one vocabulary file without making ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        number = {s: i for i, s in enumerate(dict.fromkeys([*byte_symbols(), *(x for m in merges for x in m), *("".join(m) for m in merges)]))}
        #: pair of symbol numbers -> rank and merged symbol; symbol numbers of single bytes are the bytes
        self.merge = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.pretoken = regex.compile(PRETOKEN)
        special = [regex.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(special)) if special else None
        self.known = Numbers(self.fill, np.int64)
        self.of_token: dict[str, int] = {}

    def merged(self, word: bytes) -> int:
        """Initial symbols minus merges: the lowest-ranked adjacent pair is popped and merged until none is left."""
        n = len(word)
        if n < 2:
            return n
        merge = self.merge
        sym = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, i, a, b) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if (found := merge.get((a, b)))]
        heapify(heap)
        # An entry is (rank, merged symbol, left position, left symbol, right symbol); stale ones no longer match.
        left = n
        while heap:
            _, to, i, a, b = heappop(heap)
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue
            left -= 1
            sym[i], sym[j] = to, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merge.get((to, sym[k])):
                    heappush(heap, (*found, i, to, sym[k]))
            h = before[i]
            if h >= 0 and (found := merge.get((sym[h], to))):
                heappush(heap, (*found, h, sym[h], to))
        return left

    def token(self, token: str) -> int:
        n = self.of_token.get(token)
        if n is None:
            if len(self.of_token) > 200_000:
                self.of_token.clear()
            n = self.of_token[token] = self.merged(token.encode())
        return n

    def plain(self, text: str) -> int:
        return sum(map(self.token, self.pretoken.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of a text; a special string is one token."""
        if self.special is None or not (found := self.special.findall(text)):
            return self.plain(text)
        return len(found) + sum(map(self.plain, self.special.split(text)))

    def fill(self, new: list[str]) -> list[int]:
        return [self.count(c) for c in new]

    def counts(self, texts: list[str]) -> np.ndarray:
        pieces = [chunks(t) for t in texts]
        rows = self.known.rows([c for p in pieces for c in p])
        each = self.known.values[rows]
        ends = np.concatenate([[0], np.cumsum(each)])
        return np.diff(ends[np.cumsum([0, *map(len, pieces)])])


@functools.lru_cache(2)
def counter(path: str) -> MergeCounter:
    """One counter per vocabulary and Python worker."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, n_bytes, n_tokens, over_limit`, one for each row of `docs` (repeated rows too), without a shuffle.

    A null or empty text has 0 bytes and 0 tokens; other columns are ignored, an empty table gives no rows.
    Words are merged once per worker and remembered in a table of bounded size.
    """

    def run(batches):
        c = counter(vocabulary)
        for b in slices(batches):
            col = b.column("text")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pc.binary_length(col).cast(pa.int64()), pa.array(c.counts(col.to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
