"""Chunks of a text that a byte-pair tokenizer treats independently, and bounded tables of what is known about chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged

# Characters on which Python and the tokenizer libraries differ about white space: such texts are taken whole.
_UNSURE = re.compile("[\x1c-\x1f\x85᠎]")
_UNSURE_BYTES = re.compile(b"[\x1c-\x1f]|\xc2\x85|\xe1\xa0\x8e")
# A full stop or comma at a word's end stands alone, so the word is known without it.
_CHUNK = re.compile(r"\s*[^\W\d_]+(?=[.,]?(?:\s|\Z))|[.,](?=\s|\Z)|\s*\S+|\s+")
_WORD = re.compile(r"[^\W\d_]+(?=[.,]?(?:\s|\Z))|[.,](?=\s|\Z)|\S+")


def chunks(text: str, spaces: bool = True) -> list[str]:
    """Pieces of `text`, each from a run of white space to the end of the word after it, or of its letters.

    No pre-token of a byte-pair tokenizer reaches from a word into the white space after it, or from letters into
    a full stop or comma, so the ids of the text are those of its pieces in turn. `spaces=False` leaves white space out, for tokenizers that drop it.
    """
    if _UNSURE.search(text):
        return [text]
    return (_CHUNK if spaces else _WORD).findall(text)


class Table(dict):
    """Chunk -> row number; rows of new chunks are filled in batches by `fill`.

    Beyond `limit` chunks only the first `keep` (mostly the frequent ones) survive, so the memory is bounded;
    forgotten chunks are computed again.
    """

    def __init__(self, fill: Callable[[list[str]], Iterable], limit: int = 650_000, keep: int = 200_000):
        super().__init__()
        self.fill, self.limit, self.keep, self.new = fill, limit, keep, []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def rows(self, keys: list[str]) -> np.ndarray:
        """Row numbers of `keys`; afterwards `fill` has been told of every new one."""
        if len(self) > self.limit:
            first = list(self)[: self.keep]
            self.clear()
            self.update(zip(first, range(self.keep), strict=True))
            self.cut(self.keep)
        out = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        if self.new:
            new, self.new = self.new, []
            self.add(self.fill(new))
        return out

    def cut(self, n: int) -> None:
        raise NotImplementedError

    def add(self, values: Iterable) -> None:
        raise NotImplementedError


class Numbers(Table):
    """Chunk -> a number or a row of numbers."""

    def __init__(self, fill, dtype=np.int64, width: int = 0, **bounds):
        super().__init__(fill, **bounds)
        self.values = np.zeros((1024, width) if width else 1024, dtype)
        self.used = 0

    def cut(self, n: int) -> None:
        self.used = n

    def add(self, values: Iterable) -> None:
        new = np.asarray(values, self.values.dtype)
        if self.used + len(new) > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros((self.used + 2 * len(new), *self.values.shape[1:]), self.values.dtype)])
        self.values[self.used : self.used + len(new)] = new
        self.used += len(new)


class Ids(Table):
    """Chunk -> its token ids."""

    def __init__(self, fill, **bounds):
        super().__init__(fill, **bounds)
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cut(self, n: int) -> None:
        self.start, self.size = self.start[:n], self.size[:n]
        self.flat = self.flat[: int(self.start[-1] + self.size[-1])]

    def add(self, values: Iterable[list[int]]) -> None:
        values = list(values)
        size = np.fromiter(map(len, values), np.int64, len(values))
        self.append(np.fromiter(chain.from_iterable(values), np.uint32, int(size.sum())), size)

    def append(self, new: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, new])

    def encode(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts given as chunks, and the number of ids of each text."""
        rows = self.rows(list(chain.from_iterable(pieces)))
        size = self.size[rows]
        ends = np.concatenate([[0], np.cumsum(size)])
        cuts = np.cumsum([0, *map(len, pieces)])
        return self.flat[ragged(self.start[rows], size)], np.diff(ends[cuts])


JOINED = 64


#: Letters below U+0130: a run of them, after one space where spaces count, surely is one pre-token.
_LETTERS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+"


class FlatIds(Ids):
    """The same where new chunks come as one array of ids and their numbers of ids."""

    def add(self, values: tuple[np.ndarray, np.ndarray]) -> None:
        self.append(*values)


class Encoder:
    """Ids of chunks by the tokenizers library; plain words are encoded many at a time.

    A token's text tells where one of those words begins (the mark of a space) or ends (the mark of a word's end).
    """

    def __init__(self, path: str, spaces: bool):
        from .common import fork_safe

        fork_safe()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.spaces = Tokenizer.from_file(path), spaces
        # Where normalisation only lower-cases ASCII letters and a run of them is one pre-token, words of those letters
        # need the model alone.
        low, self.quick = ascii_letters.lower(), None
        n, p = self.tok.normalizer, self.tok.pre_tokenizer
        if not spaces and n and p and n.normalize_str(ascii_letters) == low and [x for x, _ in p.pre_tokenize_str(low)] == [low]:
            self.quick = Tokenizer(self.tok.model)
            self.quick.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.plain = re.compile(" " * spaces + _LETTERS).fullmatch
        self.mark = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.mark[i] = token.startswith("\u0120") if spaces else token.endswith("</w>")

    def _batch(self, texts: list[str], quick: bool = False) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in (self.quick if quick and self.quick else self.tok).encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def __call__(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((self.plain(c) is not None for c in new), bool, len(new))
        at_plain = np.flatnonzero(plain)
        if self.quick:  # those of ASCII letters last
            at_plain = at_plain[np.argsort([new[i].isascii() for i in at_plain], kind="stable")]
        words, others = [new[i] for i in at_plain], [c for c, x in zip(new, plain, strict=True) if not x]
        joint = "" if self.spaces else " "
        cut = sum(not c.isascii() for c in words) if self.quick else len(words)
        ids = np.concatenate([self._batch([joint.join(part[i : i + JOINED]) for i in range(0, len(part), JOINED)], quick)[0] for part, quick in ((words[:cut], False), ([c.lower() for c in words[cut:]], True))])
        # A marked id begins a word, or ends one.
        at = np.flatnonzero(self.mark[ids])
        size = np.diff(at, append=len(ids)) if self.spaces else np.diff(at + 1, prepend=0)
        if len(at) != len(words) or size.sum() != len(ids):
            raise ValueError("ids of joined words can't be told apart")
        more, sizes = self._batch(others)
        ids, size = np.concatenate([ids, more]), np.concatenate([size, sizes])
        # Back into the order of the chunks.
        order = np.empty(len(new), np.int64)
        order[np.concatenate([at_plain, np.flatnonzero(~plain)])] = np.arange(len(new))
        return ids[ragged((np.cumsum(size) - size)[order], size[order])], size[order]


def library_ids(path: str, spaces: bool) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Function from texts to (ids, ids per text) by the tokenizers library, each distinct chunk encoded once per worker."""
    if (path, spaces) not in _TABLES:
        _TABLES[path, spaces] = FlatIds(Encoder(path, spaces))
    table = _TABLES[path, spaces]
    return lambda texts: table.encode([chunks(t, spaces) for t in texts])


class WordIds:
    """Ids of Arrow columns of texts (no nulls) for a tokenizer that drops white space, with Arrow arrays as table of known words.

    Words lie between ASCII white space; a full stop or comma after letters stands alone, as in `chunks`. Each distinct
    word of a column is looked up once, only unknown ones become Python strings. The table is bounded as `Table` is.
    """

    def __init__(self, path: str, limit: int = 650_000, keep: int = 200_000):
        self.path, self.encoder, self.limit, self.keep = path, Encoder(path, False), limit, keep
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.tails = pa.array(["", ".", ","])
        self.tail_ids = self.known(self.tails)

    def known(self, words: pa.Array) -> pa.Array:
        """The ids of each of the words, as the bytes of little-endian unsigned 32-bit integers."""
        if len(self.words) > self.limit:
            self.words, self.ids = (pa.concat_arrays([x.slice(0, self.keep)]) for x in (self.words, self.ids))
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            unknown = pc.filter(words, at.is_null())
            new = pc.unique(unknown)
            ids, size = self.encoder(new.to_pylist())
            ends = np.append(0, np.cumsum(size) * 4).astype(np.int32)
            own = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
            at = pc.replace_with_mask(at, at.is_null(), pc.add(pc.index_in(unknown, value_set=new), pa.scalar(len(self.words), pa.int32())))
            self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, own])
        return self.ids.take(at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each text."""
        words = pc.ascii_split_whitespace(texts.cast(pa.string()))
        each = pc.dictionary_encode(words.flatten())
        distinct = each.dictionary
        if not len(distinct) or _UNSURE_BYTES.search(distinct.buffers()[2] or b""):
            return library_ids(self.path, False)(texts.to_pylist())
        body = pc.utf8_slice_codeunits(distinct, 0, -1)
        cut = pc.and_(pc.or_(pc.ends_with(distinct, "."), pc.ends_with(distinct, ",")), pc.utf8_is_alpha(body))
        tail = pc.if_else(cut, pc.utf8_slice_codeunits(distinct, -1), "")
        tail_ids = self.tail_ids.take(pc.index_in(tail, value_set=self.tails))
        ids = pc.binary_join_element_wise(self.known(pc.if_else(cut, body, distinct)), tail_ids, b"").take(each.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1) // 4
        cuts = words.offsets.to_numpy()
        return np.frombuffer(ids.buffers()[2] or b"", "<u4", int(ends[-1])), np.diff(ends[cuts - cuts[0]]).astype(np.int64)


def word_ids(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """The same as `library_ids` without white space, for Arrow columns."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path].encode


_WORDS: dict[str, WordIds] = {}
_TABLES: dict[tuple[str, bool], FlatIds] = {}
