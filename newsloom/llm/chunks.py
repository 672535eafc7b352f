"""Corpus-wide questions asked by chunks of documents.

Counting every n-gram or fingerprint of a corpus as one row each moves many times the input. Here documents are dealt
once into chunks; a chunk sends its distinct keys, sorted and packed, in one block for each key partition; the
partition merges the blocks of all chunks and answers each in the order of its keys. Answers go without keys: a chunk
finds its keys anew from its documents. A hot key is one entry for each chunk, however many documents hold it, so no
partition holds more entries of a key than there are chunks.

Texts travel as compressed blocks. Every step is a group in Arrow: what a task lost is computed again.
"""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import shuffle_width

BLOCK_SCHEMA = "g int, block binary"
PART_SCHEMA = "p int, g int, block binary"
REPLY_SCHEMA = "g int, p int, kind int, block binary"

Columns = dict[str, np.ndarray]
#: By kind: the columns of the answers, and which entries they are for (None: all).
Merge = Callable[[np.ndarray, np.ndarray, Columns], dict[int, tuple[Columns, np.ndarray | None]]]


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(keys: np.ndarray | None, columns: Columns) -> bytes:
    """Columns of numbers, bytes of equal weight together, with sorted keys as differences."""
    parts = ({"_keys": np.diff(keys, prepend=np.uint64(0))} if keys is not None else {}) | columns
    n = len(next(iter(parts.values())))
    body, head = [], []
    for name, x in parts.items():
        x = np.ascontiguousarray(x)
        body.append(x.view(np.uint8).reshape(n, x.dtype.itemsize).T.tobytes())
        head.append(f"{name}:{x.dtype.str}")
    return squeeze(f"{n};{','.join(head)}\n".encode() + b"".join(body))


def unpack(block: bytes) -> tuple[np.ndarray | None, Columns]:
    data = expand(block)
    cut = data.index(b"\n")
    n, names = data[:cut].decode().split(";")
    n, at, out = int(n), cut + 1, {}
    for item in names.split(","):
        name, kind = item.split(":")
        dtype = np.dtype(kind)
        raw = np.frombuffer(data, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out[name] = np.ascontiguousarray(raw.T).reshape(-1).view(dtype)
        at += n * dtype.itemsize
    return (np.cumsum(out.pop("_keys"), dtype=np.uint64) if "_keys" in out else None), out


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys of so many bits: the others are 0, which take no room in a block."""
    return keys & ~np.uint64((1 << (64 - bits)) - 1)


def width(docs: DataFrame) -> int:
    """The number of chunks: twice the session's shuffle partitions."""
    return 2 * shuffle_width(docs.sparkSession)


def key_parts(docs: DataFrame) -> int:
    """The number of key partitions of each kind; a chunk sends one block at most to each."""
    return max(1, shuffle_width(docs.sparkSession) // 2)


def chunk_of(id_col: str, text_col: str, n: int) -> F.Column:
    """The chunk of a row, by its id and the length of its text, so that rows of one id may spread."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))), F.lit(n)).cast("int")


def deal(docs: DataFrame, id_col: str, text_col: str, g_col: F.Column | None = None) -> DataFrame:
    """``(g, block)``: the documents of each scan task in compressed blocks, dealt to their chunks."""
    g = g_col if g_col is not None else chunk_of(id_col, text_col, width(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for own, rows in held.items():
                texts = [t.encode("utf-8", "surrogatepass") for _, t in rows]
                ids = np.array([0 if i is None else i for i, _ in rows], np.int64)
                null = np.array([i is None for i, _ in rows], np.uint8)
                lengths = np.array([len(t) for t in texts], np.int64)
                head = np.array([len(rows)], np.int64)
                block = squeeze(b"".join([head.tobytes(), ids.tobytes(), null.tobytes(), lengths.tobytes(), *texts]))
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([block], pa.binary())], ["g", "block"])

        for batch in batches:
            for own, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or ""
                held.setdefault(own, []).append((i, text))
                size += len(text)
            if size > 64 << 20:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    rows = docs.select(g.alias("g"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, BLOCK_SCHEMA).repartition(shuffle_width(docs.sparkSession), "g")


def documents(blocks: list[bytes]) -> Iterator[tuple[int | None, bytes]]:
    """``(doc_id, text)`` of a chunk's blocks; the order does not depend on how the blocks arrived."""
    for data in sorted(map(expand, blocks), key=zlib.crc32):
        n = int(np.frombuffer(data, np.int64, 1)[0])
        ids = np.frombuffer(data, np.int64, n, 8)
        null = np.frombuffer(data, np.uint8, n, 8 + 8 * n)
        lengths = np.frombuffer(data[8 + 9 * n : 8 + 17 * n], np.int64)
        at = 8 + 17 * n
        for i, is_null, length in zip(ids.tolist(), null.tolist(), lengths.tolist(), strict=True):
            yield (None if is_null else i), data[at : at + length]
            at += length


def ranges(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The key partitions, by the keys' top bits, that sorted keys fall into."""
    bounds = [np.uint64((p << 64) // parts) for p in range(1, parts)]
    cuts = [0, *np.searchsorted(keys, np.array(bounds, np.uint64)).tolist(), len(keys)]
    for p in range(parts):
        if cuts[p + 1] > cuts[p]:
            yield p, slice(cuts[p], cuts[p + 1])


def part_rows(g: int, parts: int, keys: np.ndarray, columns: Columns, kind: int = 0, kinds: int = 1) -> list[tuple[int, int, bytes]]:
    """A chunk's requests of one kind of several, for every key partition that its keys fall into."""
    return [(kinds * p + kind, g, pack(keys[own], {k: v[own] for k, v in columns.items()})) for p, own in ranges(keys, parts)]


def to_table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    kinds = [pa.binary() if n == "block" else pa.int32() for n in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def ask(dealt: DataFrame, request: Callable[[int, Iterator, dict], list[tuple[int, int, bytes]]], replies: DataFrame | None = None) -> DataFrame:
    """``request(g, documents, replies of the chunk)`` gives the rows ``(p, g, block)`` of each chunk."""
    names = ["p", "g", "block"]
    if replies is None:

        def alone(left: pa.Table) -> pa.Table:
            g = left.column("g")[0].as_py()
            return to_table(request(g, documents(left.column("block").to_pylist()), {}), names)

        return dealt.groupBy("g").applyInArrow(alone, PART_SCHEMA)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return to_table([], names)
        return to_table(request(left.column("g")[0].as_py(), documents(left.column("block").to_pylist()), gathered(right)), names)

    return dealt.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(both, PART_SCHEMA)


def answer(requests: DataFrame, merges: list[Merge], totals: Callable[[int, np.ndarray, np.ndarray, Columns], bytes | None] | None = None) -> DataFrame:
    """Merge each key partition; its number modulo the number of merges says by which.

    ``merge(keys, inverse, columns)`` over all entries, ``inverse`` numbering the distinct keys, gives an answer for
    each entry; they go back to their chunks in order. ``totals`` may add one block for a partition, which is addressed
    to chunk -1 and has kind -1.
    """

    def run(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        which = p % len(merges)
        chunk_ids = table.column("g").to_pylist()
        parts = [unpack(b) for b in table.column("block").to_pylist()]
        keys = np.concatenate([k for k, _ in parts])
        columns = {name: np.concatenate([c[name] for _, c in parts]) for name in parts[0][1]}
        distinct, inverse = np.unique(keys, return_inverse=True)
        rows = []
        for kind, (out, mask) in merges[which](distinct, inverse, columns).items():
            at = 0
            for g, size in zip(chunk_ids, (len(k) for k, _ in parts), strict=True):
                own = slice(at, at + size)
                mine = {k: v[own] if mask is None else v[own][mask[own]] for k, v in out.items()}
                rows.append((g, p // len(merges), kind, pack(None, mine)))
                at += size
        if totals and (block := totals(which, distinct, inverse, columns)) is not None:
            rows.append((-1, p // len(merges), -1, block))
        return to_table(rows, ["g", "p", "kind", "block"])

    return requests.groupBy("p").applyInArrow(run, REPLY_SCHEMA)


def gathered(replies: pa.Table) -> dict[int, Columns]:
    """A chunk's replies of each kind, in the order of its sorted keys."""
    found: dict[int, list] = {}
    for p, kind, block in zip(replies.column("p").to_pylist(), replies.column("kind").to_pylist(), replies.column("block").to_pylist(), strict=True):
        found.setdefault(kind, []).append((p, block))
    out = {}
    for kind, parts in found.items():
        opened = [unpack(b)[1] for _, b in sorted(parts, key=lambda x: x[0])]
        out[kind] = {n: np.concatenate([c[n] for c in opened]) for n in opened[0]}
    return out


def finish(dealt: DataFrame, replies: DataFrame, final: Callable[[int, Iterator, dict], pa.Table], schema: str) -> DataFrame:
    """``final(g, documents, replies)`` gives the result rows of each chunk."""
    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        g = left.column("g")[0].as_py() if left.num_rows else -1
        return final(g, documents(left.column("block").to_pylist()), gathered(right)) if left.num_rows else final(g, iter(()), {})

    return dealt.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(both, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
