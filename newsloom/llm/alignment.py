"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the same bytes. Tokens are the nodes of a bipartite graph with an edge where two of them share
bytes; a union-find over arrays gives its components, which are the smallest groups that both sides cut at. Within a
component every token of one side is linked to every token of the other: as id pairs with how often they occur, so a
long component costs its distinct ids. For each id pair the documents that hold it are counted over the corpus.

Both sides cut before a lone space between two other characters: byte-level words take it at their beginning alone, and
no piece has a space after something else (the model is asked). So texts are aligned by the units between such spaces,
each once in a chunk of documents, and a document is the list of its units.

A chunk writes its documents, its units' pairs and, once each, its distinct pairs with the number of its documents that
hold them: no pair has more rows than there are chunks. The counts go back to the chunks by an equi-join, and each
chunk is settled on its own.
"""

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm.bpe import WordBpe
from newsloom.storage import discard, materialize

#: Documents of one chunk and of one step within it, in bytes of text; a longer document is alone.
CHUNK_BYTES, STEP_BYTES = 16 << 20, 1 << 20
#: Units of documents whose pairs are counted at once.
COUNTED = 1 << 18
#: A group with more links than this is linked by its distinct ids.
LARGE = 1024
#: The space before a unit.
CUT = re.compile(r"(?<=\S) (?=\S)")

WRITTEN = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, units binary, size long, pair long, docs long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of neighbouring runs of values."""
    total = np.r_[0, np.cumsum(values)]
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


class Side:
    """The bytes of one tokenizer's ids, and its ids as text with what stands before them in a group."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = np.array(pieces, object)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        ids = [str(i) for i in range(len(pieces))]
        self.comma, self.semicolon, self.bar = (np.array([mark + i for i in ids], object) for mark in ",;|")

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.pieces[ids].tolist())


class Tokenizers:
    """Both encoders: byte-level BPE on a space and the text, and a piece model that adds the space itself."""

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.byte_level = Tokenizer.from_str(byte_level)
        self.byte_level.no_truncation()
        self.byte_level.no_padding()
        self.byte_level.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        byte_of = {c: b for b, c in enumerate(WordBpe._byte_symbols())}
        by_id = {i: t for t, i in self.byte_level.get_vocab(with_added_tokens=True).items()}
        self.a = Side([self._bytes(by_id.get(i, ""), byte_of) for i in range(max(by_id) + 1)])
        m = self.model
        #: Whether a piece has a space after something else.
        self.inner = any(re.search("[^▁]▁", m.id_to_piece(i)) for i in range(m.vocab_size()))
        self.b = Side([bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.vocab_size())])

    @staticmethod
    def _bytes(token: str, byte_of: dict[str, int]) -> bytes:
        return bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of both sides in a row, and how many each text has; none where it does not come back from its tokens."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        found = [e.ids for e in self.byte_level.encode_batch_fast([" " + s for s in strings], add_special_tokens=False)], self.model.encode(strings, num_threads=1)
        sizes = [np.fromiter(map(len, f), np.int64, len(texts)) for f in found]
        ids = [np.fromiter(chain.from_iterable(f), np.int64, int(n.sum())) for f, n in zip(found, sizes, strict=True)]
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        whole = b" " + b" ".join(texts)
        same = [(sums(side.lengths[x], n) == length).all() and side.joined(x) == whole for side, x, n in zip((self.a, self.b), ids, sizes, strict=True)]
        if texts and not all(same):  # some texts do not come back
            ends = [np.cumsum(n) for n in sizes]
            ok = [all(side.joined(x[e[i] - n[i] : e[i]]) == b" " + t for side, x, e, n in zip((self.a, self.b), ids, ends, sizes, strict=True)) for i, t in enumerate(texts)]
            ids = [x[np.repeat(ok, n)] for x, n in zip(ids, sizes, strict=True)]
            sizes = [n * np.array(ok) for n in sizes]
        return ids, sizes

    def units(self, text: bytes) -> list[bytes]:
        """What a text is cut into; a text of which no lone space may be a cut is one unit."""
        if self.inner:
            return [text]
        return [u.encode() for u in CUT.split(text.decode())] if text.isascii() or _valid(text) else [text]


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def components(one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, given edges: roots are linked to smaller ones, paths are halved."""
    parent = np.arange(n)
    while len(one):
        x, y = parent[one], parent[two]
        apart = x != y
        one, two, x, y = one[apart], two[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


class Aligned:
    """Tokens of some texts, all in a row, in groups."""

    def __init__(self, known: tuple[Side, Side], ids: list[np.ndarray], sizes: list[np.ndarray]):
        self.known, self.ids, self.sizes, self.n = known, ids, sizes, len(sizes[0])
        self.doc = np.repeat(np.arange(self.n), self.sizes[0])
        ends = [np.cumsum(s.lengths[x]) for s, x in zip(known, self.ids, strict=True)]
        # Between two neighbouring cuts of either side lie bytes of one token of each: an edge. Documents end on both.
        cuts = np.union1d(*ends)
        n_a, n_b = map(len, self.ids)
        edges = [np.searchsorted(e, cuts) for e in ends]
        root = components(edges[0], edges[1] + n_a, n_a + n_b)
        number = np.cumsum(root[:n_a] == np.arange(n_a)) - 1  # a component's smallest node is its first token of side a
        self.group = [number[root[:n_a]], number[root[n_a:]]]
        self.groups = int(number[-1]) + 1 if n_a else 0
        self.size = [np.bincount(g, minlength=self.groups) for g in self.group]
        self.begin = [np.cumsum(s) - s for s in self.size]
        self.group_doc = self.doc[self.begin[0]]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, id pair and number of occurrences; a pair may come several times."""
        width = len(self.known[1].pieces)
        many = self.size[0] * self.size[1] > LARGE
        mine = ~many[self.group[0]]
        group = self.group[0][mine]
        repeat = self.size[1][group]
        first = np.cumsum(repeat) - repeat
        at = np.repeat(self.begin[1][group] - first, repeat) + np.arange(repeat.sum())
        docs, pairs = [np.repeat(self.doc[mine], repeat)], [np.repeat(self.ids[0][mine], repeat) * width + self.ids[1][at]]
        times = [np.ones(len(at), np.int64)]
        for g in np.flatnonzero(many):
            (a, n_a), (b, n_b) = (np.unique(x[i[g] : i[g] + s[g]], return_counts=True) for x, i, s in zip(self.ids, self.begin, self.size, strict=True))
            pairs.append(np.add.outer(a * width, b).ravel())
            times.append(np.multiply.outer(n_a, n_b).ravel())
            docs.append(np.full(len(pairs[-1]), self.group_doc[g]))
        return np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)

    def figures(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Of each text: groups, links, and the groups written out."""
        text = np.empty(sum(map(len, self.ids)), object)
        for side, marked, shift in ((0, self.known[0].semicolon, self.begin[1]), (1, self.known[1].bar, self.begin[0] + self.size[0])):
            ids = self.ids[side]
            place = np.arange(len(ids)) + shift[self.group[side]]
            text[place] = self.known[side].comma[ids]
            text[place[self.begin[side]]] = marked[ids[self.begin[side]]]
        groups, links = np.bincount(self.group_doc, minlength=self.n), np.zeros(self.n, np.int64)
        np.add.at(links, self.group_doc, self.size[0] * self.size[1])
        ends = np.cumsum(self.sizes[0] + self.sizes[1]).tolist()
        return groups, links, ["".join(text[low:high].tolist())[1:] for low, high in zip([0, *ends], ends, strict=False)]


def _steps(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Rows together up to so many bytes of text, which is the last of a row."""
    held, n = [], 0
    for row in rows:
        if held and n + len(row[-1]) > size:
            yield held
            held, n = [], 0
        held.append(row)
        n += len(row[-1])
    if held:
        yield held


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of some ranges in a row."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Chunk:
    """Documents that share a table of units."""

    def __init__(self, both: Tokenizers, number: int, with_groups: bool):
        self.both, self.number, self.with_groups = both, number, with_groups
        self.bytes, self.known, self.texts = 0, {}, []
        self.ok = np.empty(0, bool)
        #: By unit: tokens of both sides, groups, links; pairs; then all pairs and how often they occur.
        self.figures, self.pairs, self.pair, self.times = np.empty((0, 4), np.int64), [], [], []
        self.ids, self.sizes, self.units = [], [], []

    def add(self, step: list[tuple]) -> pa.RecordBatch:
        """Take up documents; the batch of what is known of them."""
        cut = [self.both.units(t) if t else [] for _, t in step]
        new = list(dict.fromkeys(u for units in cut for u in units if u not in self.known))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self._align(new)
        known = self.known
        units = [np.array([known[u] for u in own], np.uint32) for own in cut]
        units = [u if self.ok[u].all() else u[:0] for u in units]
        sizes = np.array([len(u) for u in units], np.int64)
        every = np.concatenate(units)
        n = [sums(self.figures[every, i], sizes) for i in range(4)]
        groups = [";".join([self.texts[i] for i in u.tolist()]) for u in units]
        digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        self.sizes.append(sizes)
        self.units.append(every)
        self.bytes += sum(len(t) for _, t in step)
        more = {"groups": groups} if self.with_groups else {}
        return _batch(len(step), chunk=[self.number] * len(step), doc_id=[i for i, _ in step], n_a=n[0], n_b=n[1], n_groups=n[2], n_links=n[3], groups_sha256=digest, units=[u.tobytes() for u in units], **more)

    def _align(self, new: list[bytes]) -> None:
        aligned = Aligned((self.both.a, self.both.b), *self.both.encode(new))
        groups, links, texts = aligned.figures()
        unit, pair, times = aligned.links()
        order = np.argsort(unit, kind="stable")
        self.pair.append(pair[order])
        self.times.append(times[order])
        self.pairs.append(np.bincount(unit, minlength=len(new)))
        self.ok = np.r_[self.ok, aligned.sizes[0] > 0]
        self.figures = np.concatenate([self.figures, np.stack([*aligned.sizes, groups, links], axis=1)])
        self.texts += texts

    def close(self) -> Iterator[pa.RecordBatch]:
        """The units' pairs, as places among the chunk's distinct ones, and these with the documents that hold them."""
        if not self.sizes:
            return
        size, every = np.concatenate(self.pairs), np.concatenate(self.pair)
        pair, place = np.unique(every, return_inverse=True)
        begin = np.cumsum(size) - size
        count = np.zeros(len(pair), np.int64)
        doc_sizes, units = np.concatenate(self.sizes), np.concatenate(self.units)
        low = first = 0
        ends = np.cumsum(doc_sizes)
        while first < len(doc_sizes):
            last = max(first + 1, int(np.searchsorted(ends, low + COUNTED, "right")))
            high = int(ends[last - 1])
            doc = np.repeat(np.arange(last - first), doc_sizes[first:last])
            own = distinct(doc << 32 | units[low:high].astype(np.int64))
            unit, doc = own & 0xFFFFFFFF, own >> 32
            found = distinct(np.repeat(doc, size[unit]) * len(pair) + place[_ranges(begin[unit], size[unit])])
            count += np.bincount(found % max(len(pair), 1), minlength=len(pair))
            low, first = high, last
        times = np.concatenate(self.times)
        times = times.astype(np.min_scalar_type(times.max(initial=0)))
        packed = size.astype(np.uint32).tobytes() + place.astype(np.uint32).tobytes() + times.tobytes()
        yield _batch(1, chunk=[self.number], units=[packed], size=[len(size)])
        yield _batch(len(pair), chunk=np.full(len(pair), self.number), pair=pair, docs=count)


FIELDS = [(f.split(" ")[0], {"string": pa.string(), "binary": pa.binary()}.get(f.split(" ")[1], pa.int64())) for f in WRITTEN.split(", ")]


def _batch(n: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(given[c], k) if c in given else pa.nulls(n, k) for c, k in FIELDS], [c for c, _ in FIELDS])


_LOADED: dict[str, Tokenizers] = {}


def _load(mark: str, shared: Broadcast) -> Tokenizers:
    """The encoders of this worker, made once. A loaded one never travels: its settings would not."""
    if mark not in _LOADED:
        _LOADED[mark] = Tokenizers(*shared.value)
    return _LOADED[mark]


def _read(docs: DataFrame, byte_level: str, pieces: str) -> tuple[Callable[[], Tokenizers], int]:
    """What gives a worker its encoders, and the size of the second vocabulary."""
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        files = f.read(), g.read()
    mark = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    size = sentencepiece.SentencePieceProcessor(model_proto=files[1]).vocab_size()
    return partial(_load, mark, docs.sparkSession.sparkContext.broadcast(files)), size


def _encode(docs: DataFrame, id_col: str, text_col: str, load: Callable[[], Tokenizers], with_groups: bool = False) -> DataFrame:
    """Rows of documents, of each chunk's units (their number in ``size``) and of each chunk's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load()
        rows = ((i, t or b"") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        chunk = Chunk(both, TaskContext.get().partitionId() << 32, with_groups)
        for step in _steps(rows, STEP_BYTES):
            if chunk.bytes and chunk.bytes + sum(len(t) for _, t in step) > CHUNK_BYTES:
                yield from chunk.close()
                chunk = Chunk(both, chunk.number + 1, with_groups)
            yield chunk.add(step)
        yield from chunk.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, WRITTEN)


def settle(own: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one chunk with the counts of their pairs."""
    order = np.argsort(found.column("pair").to_numpy())
    n, is_best = found.column("docs").to_numpy()[order], found.column("best").to_numpy()[order].astype(np.int64)
    is_doc = own.column("size").is_null()
    size, packed = (own.filter(is_doc.to_numpy() == False).column(c)[0].as_py() for c in ("size", "units"))  # noqa: E712
    own = own.filter(is_doc)
    pairs = np.frombuffer(packed, np.uint32, size).astype(np.int64)
    total = int(pairs.sum())
    place, rest = np.frombuffer(packed, np.uint32, total, 4 * size), packed[4 * (size + total) :]
    times = np.frombuffer(rest, f"u{len(rest) // max(total, 1) or 1}").astype(np.int64)
    units = [np.frombuffer(u, np.uint32) for u in own.column("units").to_pylist()]
    sizes, every = np.array([len(u) for u in units], np.int64), np.concatenate(units)
    best, total_docs = (sums(sums(times * x[place], pairs)[every], sizes) for x in (is_best, n))
    out = own.drop_columns(["chunk", "size", "units"])
    at = out.schema.get_field_index("groups_sha256")
    return out.add_column(at, "n_best", pa.array(best)).add_column(at + 1, "count_sum", pa.array(total_docs))


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row of each document: tokens of both sides, groups, links, links that are the best of their id, their counts.

    ``byte_level`` (a tokenizers file) and ``pieces`` (a sentencepiece model) are read by the driver and go to the
    workers by broadcast. ``n_best`` counts the links whose pair no pair of the same first id exceeds in documents;
    ``count_sum`` adds the documents of every link's pair; ``groups`` on request has the groups themselves, as
    ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and texts that either tokenizer does not give back byte for byte, have
    no tokens: zeros and an empty digest. A row that repeats, or repeats a doc_id, is a document of its own. Other
    columns are not read. No rows: an empty result.
    """
    load, width = _read(docs, byte_level, pieces)
    written = materialize(_encode(docs, id_col, text_col, load, with_groups), "aligned")
    counts, best = _counts(written, width)
    asked = written.where("pair IS NOT NULL").select("chunk", "pair")
    top = F.broadcast(best.withColumnRenamed("a", "id"))
    replies = asked.join(counts, "pair").join(top, F.floor(F.col("pair") / width) == top["id"]).select(F.col("chunk").alias("to"), "pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    documents = written.where("pair IS NULL").drop("pair", "docs", *([] if with_groups else ["groups"]))
    return documents.groupBy("chunk").cogroup(replies.groupBy("to")).applyInArrow(settle, RESULT + ", groups string" * with_groups)


def _counts(written: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Documents of each pair, and the most that a pair of each first id has: a row for each id of a vocabulary at most."""
    counts = materialize(written.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("docs")), "pair-counts")
    best = counts.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("docs").alias("most"))
    return counts, materialize(best, "best-pairs", free=False)


def pair_counts(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a, b, docs, best)``: every linked id pair, the documents that hold it, and whether no pair of ``a`` has more."""
    load, width = _read(docs, byte_level, pieces)
    written = materialize(_encode(docs, id_col, text_col, load), "aligned")
    counts, best = _counts(written, width)
    discard(written)
    pairs = counts.select(F.floor(F.col("pair") / width).alias("a"), (F.col("pair") % width).alias("b"), "docs")
    return pairs.join(F.broadcast(best), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))
