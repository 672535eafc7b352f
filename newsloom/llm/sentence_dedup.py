"""Substring deduplication by sliding sentence spans.

Every run of three consecutive sentences is hashed, the spans of all documents are joined globally, and sentences go
that any repeated span covers which is not the first of its kind in the order of doc_id and place. ``chunks`` does the
join: a chunk sends each distinct span once with its smallest document and learns whether another chunk has it earlier,
so a span that a third of all documents hold is one entry for each chunk.

Runs of words are found besides on request: a passage spliced into a sentence leaves fewer than three whole sentences.
As in ``substring_dedup`` the least 16-word string of each window is its anchor; chunks learn which anchors stand in
more than one place, and compare every window round those alone. Equal windows have equal anchors, so none is lost.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from newsloom.llm import chunks
from newsloom.llm.substring_dedup import ANCHOR, KEY_BITS, _batches, _earlier, _Entries, _Hashes, _slide
from newsloom.storage import materialize

SPAN = 3
#: The shortest run of words that the query removes wherever it stands in its sentences.
WORDS = 50
#: A sentence runs to its closing marks and the white space after them, or to the end of its line.
SENTENCE = regex.compile(rb"[^.!?\n]*+(?:[.!?]++(?=\s|$)|[.!?]++|\n|$)\s*+")


def sentences(text: bytes) -> list[bytes]:
    """The sentences in order; together they are the text again."""
    out: list[bytes] = []
    for m in SENTENCE.finditer(text):
        piece = m.group()
        if not piece:
            continue
        # A mark inside a word, as in 3.5, ends no sentence; blank pieces belong to the sentence before.
        joined = out and (not piece.strip() or not out[-1][-1:].isspace())
        if joined:
            out[-1] += piece
        else:
            out.append(piece)
    return out


class _Words:
    """The words of a batch of documents as hashes, and the anchors of its windows of ``size`` words."""

    def __init__(self, ids: list, texts: list, size: int):
        self.size = size
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        after = np.r_[True, space[:-1]]
        begin, end = np.flatnonzero(~space & after), np.flatnonzero(space & ~after)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(begin, starts)
        row = np.repeat(np.arange(len(ids)), np.diff(self.bounds))
        self.begin = begin - starts[row]
        self.doc = np.array([0 if i is None else i for i in ids], np.int64)[row]
        self.word = chunks.mix64(_Hashes(data, 0).of(begin, end))
        n = len(begin)
        self.at, self.anchor = np.empty(0, np.int64), np.empty(0, np.uint64)
        if n < size:
            return
        key = chunks.mix64(_Hashes(self.word, 0).all(ANCHOR))
        width = size - ANCHOR + 1
        least = _slide(key, width, np.minimum)
        real = np.array([i is not None for i in ids])[row]
        #: Windows that lie in one document, by their start.
        self.inside = (np.arange(n - size + 1) + size <= self.bounds[row[: n - size + 1] + 1]) & real[: n - size + 1]
        reach = np.zeros(len(key) + width - 1, np.uint64)
        reach[width - 1 : width - 1 + len(least)] = np.where(self.inside, least, np.uint64(0))
        self.at = np.flatnonzero((_slide(reach, width, np.maximum) == key) & (key > 0))
        self.anchor = chunks.short(key[self.at], KEY_BITS)

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Round the anchors chosen: start, document, key and check of every window, in order."""
        at = self.at[shared]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32)
        change = np.zeros(len(self.word) + 1, np.int64)
        np.add.at(change, np.maximum(at - (self.size - ANCHOR), 0), 1)
        np.add.at(change, at + 1, -1)
        begin = np.flatnonzero((np.cumsum(change)[: len(self.inside)] > 0) & self.inside)
        key, check = (chunks.mix64(_Hashes(self.word, which).of(begin, begin + self.size)) for which in (0, 1))
        return begin, self.doc[begin], chunks.short(key, 56), (check >> np.uint64(32)).astype(np.uint32)

    def covered(self, begin: np.ndarray) -> np.ndarray:
        """Which words the windows cover that start so."""
        change = np.zeros(len(self.word) + 1, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + self.size, -1)
        return np.cumsum(change[:-1]) > 0


def _ordered(docs: Iterator) -> list[tuple[int | None, bytes]]:
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1]))


def _not_first(entries: _Entries, earlier: np.ndarray) -> np.ndarray:
    """Which elements are not the first of their kind; the chunk's own are in order of document and place."""
    _, first = np.unique(entries.of, return_index=True)
    return (earlier[entries.of] > 0) | (first[entries.of] != np.arange(len(entries.of)))


class _Chunk:
    """A chunk's sentences, and the entries of its spans."""

    def __init__(self, docs: list, min_words: int | None):
        self.docs = [(i, t, sentences(t)) for i, t in docs]
        keys, checks, ids, self.place = [], [], [], []
        for row, (i, _, parts) in enumerate(self.docs):
            words = [b" ".join(p.lower().split()) for p in parts]
            spans = range(len(words) - SPAN + 1)
            if min_words and not spans and any(words):
                spans = range(1)  # all sentences there are
            for k in spans if i is not None else ():
                joined = b"\n".join(words[k : k + SPAN])
                h = xxhash.xxh3_128_intdigest(joined)
                keys.append(h >> 64)
                checks.append(h & 0xFFFFFFFF)
                ids.append(i)
                self.place.append((row, k))
        self.entries = _Entries(chunks.short(np.array(keys, np.uint64), 56), np.array(checks, np.uint32), np.array(ids, np.int64))


class _Runs:
    """A chunk's words, with the anchors that they have."""

    def __init__(self, docs: list, size: int):
        self.batches = [_Words(ids, texts, size) for ids, texts in _batches(iter(docs))]
        anchors = np.concatenate([b.anchor for b in self.batches]) if self.batches else np.empty(0, np.uint64)
        self.anchors, self.of, self.count = np.unique(anchors, return_inverse=True, return_counts=True)

    def anchor_rows(self, g: int, parts: int) -> list:
        return chunks.part_rows(g, parts, self.anchors, {"many": (self.count > 1).astype(np.uint8)}, 1, 2)

    def windows(self, replies: dict) -> tuple[list[np.ndarray], _Entries]:
        """The starts by batch, and the entries, of the windows round shared anchors."""
        shared = replies[1]["shared"][self.of] > 0 if len(self.anchors) else np.empty(0, bool)
        cuts = np.cumsum([len(b.at) for b in self.batches])[:-1]
        found = [b.windows(own) for b, own in zip(self.batches, np.split(shared, cuts), strict=True)] if self.batches else []
        doc, key, check = (np.concatenate([f[k] for f in found]) if found else np.empty(0, t) for k, t in ((1, np.int64), (2, np.uint64), (3, np.uint32)))
        return [f[0] for f in found], _Entries(key, check, doc)


def _shared(distinct: np.ndarray, inverse: np.ndarray, columns: chunks.Columns) -> dict:
    """Whether an anchor stands in more than one place."""
    places = np.bincount(inverse, weights=1.0 + columns["many"], minlength=len(distinct))
    return {1: ({"shared": (places > 1).astype(np.uint8)[inverse]}, None)}


def _ask(parts: int, min_words: int | None):
    def request(g: int, docs: Iterator, _: dict) -> list:
        own = _ordered(docs)
        rows = _Chunk(own, min_words).entries.rows(g, parts, 0, 2)
        return rows + _Runs(own, min_words).anchor_rows(g, parts) if min_words else rows

    return request


def _ask_windows(parts: int, min_words: int):
    def request(g: int, docs: Iterator, replies: dict) -> list:
        return _Runs(_ordered(docs), min_words).windows(replies)[1].rows(g, parts, 0, 1)

    return request


def _covered(docs: list, replies: dict, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By document: where its words begin, and which of them are in a repeated run."""
    runs = _Runs(docs, min_words)
    begins, entries = runs.windows(replies)
    hit = _not_first(entries, replies[2]["earlier"]) if len(entries.of) else np.empty(0, bool)
    for batch, begin, own in zip(runs.batches, begins, np.split(hit, np.cumsum([len(b) for b in begins])[:-1]), strict=True):
        gone = batch.covered(begin[own])
        for low, high in zip(batch.bounds[:-1].tolist(), batch.bounds[1:].tolist(), strict=True):
            yield batch.begin[low:high], gone[low:high]


def _kept(text: bytes, parts: list[bytes], cut: np.ndarray, begin: np.ndarray, gone: np.ndarray) -> tuple[int, bytes]:
    """The sentences of which no word stays, and the text without sentences and words that go."""
    bounds = np.cumsum([0, *map(len, parts)])
    of = np.searchsorted(bounds, begin, "right") - 1
    all_words, gone_words = np.bincount(of, minlength=len(parts)), np.bincount(of, weights=gone, minlength=len(parts))
    change = np.zeros(len(text) + 1, np.int64)
    for low, high in ((bounds[:-1][cut], bounds[1:][cut]), (begin[gone], np.r_[begin[1:], len(text)][gone])):
        np.add.at(change, low, 1)
        np.add.at(change, high, -1)
    kept = np.frombuffer(text, np.uint8)[np.cumsum(change[:-1]) == 0].tobytes()
    return int((cut | ((all_words > 0) & (gone_words == all_words))).sum()), kept


def _final(with_text: bool, min_words: int | None):
    def final(g: int, docs: Iterator, replies: dict) -> pa.Table:
        own = _ordered(docs)
        chunk = _Chunk(own, min_words)
        cuts = [np.zeros(len(parts), bool) for _, _, parts in chunk.docs]
        if chunk.place:
            for at in np.flatnonzero(_not_first(chunk.entries, replies[0]["earlier"])):
                row, k = chunk.place[at]
                cuts[row][k : k + SPAN] = True
        none = np.empty(0, np.int64), np.empty(0, bool)
        words = _covered(own, replies, min_words) if min_words else (none for _ in own)
        rows = []
        for (i, text, parts), cut, (begin, gone) in zip(chunk.docs, cuts, words, strict=True):
            n, kept = _kept(text, parts, cut, begin, gone) if cut.any() or gone.any() else (0, text)
            rows.append((i, len(parts), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        arrays = [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
        names = ["doc_id", "n_sentences", "n_removed", "kept_sha256", "kept_text"]
        return pa.table(arrays[: 4 + with_text], names=names[: 4 + with_text])

    return final


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, min_words: int | None = None) -> DataFrame:
    """``(doc_id, n_sentences, n_removed, kept_sha256)`` of every row, with the kept text on request.

    Sentences are compared in lower case (A-Z) with white space as single spaces. Texts of fewer than three sentences
    stay whole; a null text counts as empty. With ``min_words`` (``ANCHOR`` at least) two things go besides: texts of
    fewer than three sentences that repeat another such text as a whole, and every word in a run of so many words that
    an earlier place holds, with the white space after it; ``n_removed`` counts sentences of which no word stays. Rows that repeat a doc_id: those in one chunk (equal lengths) are one
    sequence of documents, others take nothing from each other. A row with a null doc_id has no place in the order: it
    stays whole and takes nothing from others. No rows: an empty result.
    """
    parts = chunks.key_parts(docs)
    dealt = chunks.deal(docs, id_col, text_col)
    replies = materialize(chunks.answer(chunks.ask(dealt, _ask(parts, min_words)), [_earlier(0), _shared]), "spans")
    if min_words:
        windows = chunks.answer(chunks.ask(dealt, _ask_windows(parts, min_words), replies), [_earlier(2)])
        replies = replies.unionByName(materialize(windows, "word-runs"))
    schema = "doc_id long, n_sentences long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return chunks.finish(dealt, replies, _final(with_text, min_words), schema)
