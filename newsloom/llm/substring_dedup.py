"""Removal of byte strings that an earlier document holds, by sampled suffixes and prefix polynomial hashes.

A suffix sort of all positions would move more than ten times the input. Of each 50-byte window only the suffix at its
anchor is sampled: the 20-byte string in it with the smallest hash. Equal windows have equal anchors at equal places,
so none is lost, and about one position in sixteen is sampled. Prefix polynomial hashes give the hash of any
substring in constant time. Suffixes are compared by them: first the anchors; then, at anchors that several documents
share, the whole common extension that matters (30 bytes to the left, 50 to the right); and where only part of that
extension agrees, each 50-byte window in it. A second hash with another base
verifies every match: a removal rests on 80 bits, not on the bytes themselves.

``chunks`` does the exchange; anchors with their sides, whole extensions and windows are asked for one after the other,
so that the disk holds the requests of one kind at a time. A hot passage is one entry for each chunk of documents, wherever it stands.
"""

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm import chunks
from newsloom.storage import materialize

SPAN, ANCHOR = 50, 16
WINDOWS = SPAN - ANCHOR + 1
HALF = (SPAN - ANCHOR) // 2
#: Bits of the keys; 32 bits of a second hash stand beside them where a match decides.
KEY_BITS = 48
#: Documents are hashed together up to so many bytes, which a core's cache holds; a longer one is hashed alone.
BATCH = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
LARGEST = np.iinfo(np.int64).max


class _Powers:
    """Powers of a base and of its inverse modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BATCH)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in BASES]


class _Hashes:
    """Substring hashes of one byte array."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _POWERS[which].get(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.prefix[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[begin]) * self.down[begin]

    def all(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        return (self.prefix[size:] - self.prefix[:n]) * self.down[:n]


def _slide(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``size`` neighbours, by doubling."""
    step = 1
    while 2 * step <= size:
        x = pick(x[:-step], x[step:])
        step *= 2
    rest = size - step
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def _batches(docs: Iterator) -> Iterator[tuple[list, np.ndarray]]:
    """Documents together: their ids, and the bytes of all in one array with the bounds of each."""
    ids, texts, size = [], [], 0
    for doc_id, text in docs:
        if texts and size + len(text) > BATCH:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


class _Sampled:
    """The sampled suffixes of a batch: keys of anchors with a side and of their extensions, with place and document."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.data = ids, np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = np.cumsum([0, *map(len, texts)])
        doc = np.array([LARGEST if i is None else i for i in ids], np.int64)
        real = np.array([i is not None for i in ids])
        n = len(self.data)
        if n < SPAN:
            self.at = self.doc = self.low = self.high = np.empty(0, np.int64)
            self.left = self.right = self.extension = np.empty(0, np.uint64)
            self.check = np.empty(0, np.uint32)
            return
        first, second = (_Hashes(self.data, which) for which in (0, 1))
        # The upper half depends on every byte. No key is 0, which marks windows that are none.
        key = np.maximum((first.all(ANCHOR) >> np.uint64(32)).astype(np.uint32), 1)
        least = _slide(key, WINDOWS, np.minimum)  # for each window by its start
        for i, (low, high) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)):
            least[max(low, high - SPAN + 1) if real[i] else low : high] = 0  # windows of two documents, or of no document
        reach = np.zeros(len(key) + WINDOWS - 1, np.uint32)
        reach[WINDOWS - 1 : WINDOWS - 1 + len(least)] = least
        self.at = np.flatnonzero((_slide(reach, WINDOWS, np.maximum) == key) & (key > 0))
        own = np.searchsorted(self.bounds, self.at, "right") - 1
        self.doc = doc[own]
        self.low = np.maximum(self.at - (WINDOWS - 1), self.bounds[own])
        self.high = np.minimum(self.at + SPAN, self.bounds[own + 1])
        # The anchor's place in its extension is part of both hashes.
        shape = chunks.mix64(((self.at - self.low) * 64 + self.high - self.at + 1).astype(np.uint64))
        halves = ((self.at - HALF, self.at + ANCHOR, 1), (self.at, self.at + ANCHOR + HALF, 2))
        self.left, self.right = (chunks.short(chunks.mix64(first.of(np.maximum(low, 0), np.minimum(high, n)) + np.uint64(salt)), KEY_BITS) for low, high, salt in halves)
        # A side that the document does not have gets a key of its own, which no shared window needs.
        none = chunks.short(chunks.mix64(shape + self.doc.astype(np.uint64)), KEY_BITS)
        self.left = np.where(self.at - HALF >= self.low, self.left, none)
        self.right = np.where(self.at + ANCHOR + HALF <= self.high, self.right, none)
        self.extension = chunks.short(chunks.mix64(first.of(self.low, self.high) + shape), KEY_BITS)
        self.check = (chunks.mix64(second.of(self.low, self.high) + shape) >> np.uint64(32)).astype(np.uint32)

    def windows(self, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the suffixes chosen: start, document, key and check of every window in their extensions, each once."""
        low, sizes = self.low[mine], self.high[mine] - SPAN + 1 - self.low[mine]
        begin = np.repeat(low - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(sizes) else low
        begin, first = np.unique(begin, return_index=True)
        doc = np.repeat(self.doc[mine], sizes)[first]
        if not len(begin):
            return begin, doc, np.empty(0, np.uint64), np.empty(0, np.uint32)
        key, check = (chunks.mix64(_Hashes(self.data, which).of(begin, begin + SPAN)) for which in (0, 1))
        return begin, doc, chunks.short(key, KEY_BITS), (check >> np.uint64(32)).astype(np.uint32)


class _Entries:
    """Distinct (key, check) in order, the smallest document of each, and the entry of every element."""

    def __init__(self, key: np.ndarray, check: np.ndarray, doc: np.ndarray):
        order = np.argsort(key)
        k, c = key[order], check[order]
        same = k[1:] == k[:-1]
        if (c[1:][same] != c[:-1][same]).any():  # keys that meet by chance
            order = np.lexsort((check, key))
            k, c = key[order], check[order]
            same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        new = np.r_[True, ~same] if len(k) else np.empty(0, bool)
        self.key, self.check = k[new], c[new]
        self.doc = np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(k) else doc
        self.of = np.empty(len(k), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def rows(self, g: int, parts: int, kind: int = 0, kinds: int = 1) -> list:
        return chunks.part_rows(g, parts, self.key, {"check": self.check, "doc": self.doc}, kind, kinds)

    def later(self, doc: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Which elements a smaller document has too, given the entries that another chunk has in one."""
        return (earlier[self.of] > 0) | (doc > self.doc[self.of])


def _earlier(kind: int):
    """Whether another chunk has the same key and check in a smaller document."""

    def merge(_: np.ndarray, inverse: np.ndarray, columns: chunks.Columns) -> dict:
        all_of = _Entries(inverse.astype(np.uint64), columns["check"], columns["doc"])
        return {kind: ({"earlier": (all_of.doc[all_of.of] < columns["doc"]).astype(np.uint8)}, None)}

    return merge


def _varied(distinct: np.ndarray, inverse: np.ndarray, columns: chunks.Columns) -> dict:
    """Whether an anchor with one of its sides stands in more than one extension."""
    order = np.argsort(inverse, kind="stable")
    begin = np.flatnonzero(np.diff(inverse[order], prepend=-1))
    check = columns["check"][order]
    differs = np.minimum.reduceat(check, begin) != np.maximum.reduceat(check, begin)
    differs |= np.maximum.reduceat(columns["many"][order], begin) > 0
    return {0: ({"varied": differs.astype(np.uint8)[inverse]}, None)}


class _Chunk:
    """All batches of a chunk, with their entries."""

    def __init__(self, docs: Iterator):
        self.batches = [_Sampled(ids, texts) for ids, texts in _batches(docs)]
        self.cuts = np.cumsum([len(s.at) for s in self.batches])[:-1]
        self.doc = self._all("doc")

    @cached_property
    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of anchors with a side, and the key of every left and right side."""
        return np.unique(np.r_[self._all("left"), self._all("right")], return_inverse=True)

    @cached_property
    def entries(self) -> _Entries:
        return _Entries(self._all("extension"), self._all("check"), self.doc)

    def _all(self, name: str) -> np.ndarray:
        return np.concatenate([getattr(s, name) for s in self.batches])

    def side_rows(self, g: int, parts: int) -> list:
        sides, side_of = self.sides
        check = np.tile(self._all("check"), 2)
        order = np.argsort(side_of, kind="stable")
        begin = np.flatnonzero(np.diff(side_of[order], prepend=-1))
        low, high = (f.reduceat(check[order], begin) if len(begin) else check[:0] for f in (np.minimum, np.maximum))
        return chunks.part_rows(g, parts, sides, {"check": low, "many": (low != high).astype(np.uint8)})

    def judged(self, replies: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By batch: which suffixes an earlier document has with their whole extension; whose windows are to be compared."""
        if not len(self.doc):
            none = [np.empty(0, bool) for _ in self.batches]
            return none, none
        settled = self.entries.later(self.doc, replies[1]["earlier"])
        left, right = np.split(replies[0]["varied"][self.sides[1]] > 0, 2)
        compared = (left | right) & ~settled
        return np.split(settled, self.cuts), np.split(compared, self.cuts)


def _joined(windows: list[tuple]) -> tuple[np.ndarray, _Entries]:
    _, doc, key, check = (np.concatenate(x) for x in zip(*windows, strict=True))
    return doc, _Entries(key, check, doc)


def _ask_sides(parts: int):
    return lambda g, docs, _: _Chunk(docs).side_rows(g, parts)


def _ask_extensions(parts: int):
    return lambda g, docs, _: _Chunk(docs).entries.rows(g, parts)


def _ask_windows(parts: int):
    def request(g: int, docs: Iterator, replies: dict) -> list:
        chunk = _Chunk(docs)
        _, compared = chunk.judged(replies)
        return _joined([s.windows(c) for s, c in zip(chunk.batches, compared, strict=True)])[1].rows(g, parts)

    return request


NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _removed(with_text: bool):
    def final(g: int, docs: Iterator, replies: dict) -> pa.Table:
        rows: list[tuple] = []
        chunk = _Chunk(docs)
        settled, compared = chunk.judged(replies)
        windows = [s.windows(c) for s, c in zip(chunk.batches, compared, strict=True)]
        doc, entries = _joined(windows)
        later = entries.later(doc, replies[2]["earlier"]) if len(doc) else np.empty(0, bool)
        found = np.split(later, np.cumsum([len(w[0]) for w in windows])[:-1])
        for s, full, (begin, *_), hit in zip(chunk.batches, settled, windows, found, strict=True):
            change = np.zeros(len(s.data) + 1, np.int64)
            for low, high in ((s.low[full], s.high[full]), (begin[hit], begin[hit] + SPAN)):
                np.add.at(change, low, 1)
                np.add.at(change, high, -1)
            gone = np.cumsum(change[:-1]) > 0
            for i, low, high in zip(s.ids, s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True):
                own = gone[low:high]
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                kept = s.data[low:high][~own].tobytes()
                rows.append((i, high - low, int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.table(arrays[: 6 if with_text else 5], names=[*NAMES, "kept"][: 6 if with_text else 5])

    return final


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row, with the kept bytes on request.

    Each byte goes that is covered by a 50-byte string which also starts in a document with a smaller doc_id; strings
    are those of the input and lie within one document. Texts under 50 bytes stay whole; a null text counts as empty.
    Rows that repeat a doc_id take nothing from each other. A row with a null doc_id has no place in the order: it
    stays whole and takes nothing from others. No rows: an empty result.
    """
    parts = chunks.key_parts(docs)
    dealt = chunks.deal(docs, id_col, text_col)
    sides = materialize(chunks.answer(chunks.ask(dealt, _ask_sides(parts)), [_varied]), "sides")
    extensions = materialize(chunks.answer(chunks.ask(dealt, _ask_extensions(parts)), [_earlier(1)]), "extensions")
    suffixes = sides.unionByName(extensions)
    windows = materialize(chunks.answer(chunks.ask(dealt, _ask_windows(parts), suffixes), [_earlier(2)]), "windows")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return chunks.finish(dealt, suffixes.unionByName(windows), _removed(with_text), schema)
