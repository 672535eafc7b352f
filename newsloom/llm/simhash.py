"""SimHash near-duplicates under Hamming distance, found by pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. Where two fingerprints differ in at most three bits, some
segment starts a chain round the ring whose running difference stays within its share of the budget: none in the
first segment, at most one bit in the first two, two in the first three, three in all (Qin and Xiao, VLDB 2018).
So the first segment is equal and one half of the second is; of the other 40 bits, cut in four, one part is equal.
These 34 bits are the key under which the distinct fingerprints meet. Pairs in a bucket must pass the chain test
before the full Hamming check.

Skew: equal fingerprints collapse to one before anything meets. A family of many close fingerprints is cut further
inside its bucket, by the pigeonhole principle on the bits that the key leaves open, and a bucket returns a spanning
forest of its links rather than all pairs, so that output stays linear in the input.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.exact_dedup import HOT, ROW, numbered
from newsloom.operators.graph import connected_components
from newsloom.session import shuffle_width
from newsloom.storage import materialize

SEED, SHINGLE, BUDGET = 42, 3, 3
#: Buckets above this size are cut by further bits before pairs are compared.
BLOCK = 256


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a text; null and texts without words have fingerprint 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    joined = (b" ".join(words[i : i + SHINGLE]) for i in range(n)) if n > 0 else (b" ".join(words),)
    hashes = np.fromiter((digest(s, SEED) for s in joined), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _ones(x: np.ndarray, mask: int) -> np.ndarray:
    return np.bitwise_count(x & np.uint64(mask))


def _linked(x: np.ndarray, start: int) -> np.ndarray:
    """Where the differences ``x`` keep a chain from segment ``start`` within its budgets, the last being the full check."""
    ok, mask = np.ones(x.shape, bool), 0
    for step, most in enumerate((0, 1, 2, 3)):
        mask |= 0xFFFF << (16 * ((start + step) % 4))
        ok &= _ones(x, mask) <= most
    return ok


def _cut(mask: int, parts: int) -> list[int]:
    """The set bits of ``mask`` in so many parts."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(bits[i * len(bits) // parts : (i + 1) * len(bits) // parts]) for i in range(parts)]


def _forest(fps: np.ndarray, start: int, open_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links among distinct fingerprints that agree outside ``open_bits``."""
    if len(fps) <= BLOCK:
        near = _linked(fps[:, None] ^ fps[None, :], start)
        root = np.arange(len(fps))
        while True:  # smallest reachable index; the matrix holds its own diagonal
            new = np.where(near, root[None, :], len(fps)).min(axis=1)
            new = new[new]
            if (new == root).all():
                break
            root = new
        far = root != np.arange(len(fps))
        yield fps[far], fps[root[far]]
        return
    for part in _cut(open_bits, BUDGET + 1):
        if not part:
            continue
        key = fps & np.uint64(part)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order])) + 1
        for own in np.split(order, edges):
            if len(own) > 1:
                yield from _forest(fps[own], start, open_bits & ~part)


def _keys(start: int, half: int, part: int) -> tuple[int, int]:
    """The key's mask for a start, a half of the next segment and a part of the rest; and the bits it leaves open."""
    exact = 0xFFFF << (16 * start)
    nxt = (start + 1) % 4
    exact |= 0xFF << (16 * nxt + 8 * half)
    rest = ((1 << 64) - 1) & ~exact
    own = _cut(rest, BUDGET + 1)[part]
    return exact | own, rest & ~own


SCHEMES = [(s, *_keys(s, h, p)) for s in range(4) for h in range(2) for p in range(BUDGET + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: a forest over the distinct fingerprints (column ``fp``) with the components that all links make.

    Each row joins a fingerprint to the root of its tree in one bucket; it is reached over links, not always by one.
    """
    keyed = fps.select("fp").distinct().select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(mask))) for _, mask, _ in SCHEMES])).alias("scheme", "key")
    )
    dealt = keyed.repartition(shuffle_width(fps.sparkSession), "scheme", "key").sortWithinPartitions("scheme", "key")

    def flush(scheme: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(scheme) != 0)) + 1
        begin, end = np.r_[0, new], np.r_[new, len(key)]
        size = end - begin
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        two = begin[size == 2]
        for s in range(4):
            at = two[scheme[two] // 8 == s]
            at = at[_linked(fp[at] ^ fp[at + 1], s)]
            a.append(fp[at])
            b.append(fp[at + 1])
        for i in np.flatnonzero(size > 2):
            start, _, open_bits = SCHEMES[scheme[begin[i]]]
            for x, y in _forest(fp[begin[i] : end[i]], start, open_bits):
                a.append(x)
                b.append(y)
        out = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(out, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
            held.append(cols)
            if cols[0][0] == cols[0][-1] and cols[1][0] == cols[1][-1]:
                continue  # one bucket fills the batch; it may go on
            scheme, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.flatnonzero((key != key[-1]) | (scheme != scheme[-1]))[-1] + 1
            yield flush(scheme[:last], key[:last], fp[:last])
            held = [(scheme[last:], key[last:], fp[last:])]
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.select("scheme", "key", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    Fingerprints in at most three differing bits are linked; ``component_id`` is the smallest doc_id reachable over
    links. Empty, blank and null texts share fingerprint 0 and are linked like any other; texts of one or two words
    have one shingle; repeated shingles count each time. Rows that repeat a doc_id are each returned. A null doc_id
    takes part in links but never names a component, unless all members are null. No rows: an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    first = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fp")
    linked = materialize(connected_components(links(first)).withColumnRenamed("node", "fp"), "linked-fp")
    named = first.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    classes = materialize(named.select("fp", "n", "component").join(least, "component").select("fp", "n", "component_id"), "classes")
    # A fingerprint can hold any share of the rows: those with a thousandth or more, a thousand at most, are broadcast.
    hot = classes.where(F.col("n") >= max(2, -(-rows.count() // HOT))).drop("n")
    plain = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(classes.drop("n"), "fp")
    both = plain.unionByName(rows.join(F.broadcast(hot), "fp"))
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that name their component (the smallest doc_id of each), with their columns.

    Where doc_ids repeat rows are numbered, and of rows that tie one stays.
    """
    rows = numbered(docs, id_col)
    if rows is not None:
        found = near_duplicates(rows, ROW, text_col).select(F.col("doc_id").alias(ROW), "component_id")
        own = rows.select(ROW, F.col(id_col).cast("long").alias("own")).join(found, ROW)
        first = own.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", ROW)).alias("first"))
        return rows.join(first.select(F.col("first")[ROW].alias(ROW)), ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    kept = near_duplicates(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return docs.join(kept.select(F.col("doc_id").alias("_kept_id")), F.col(id_col).eqNullSafe(F.col("_kept_id")), "left_semi")
