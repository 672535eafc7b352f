"""Boundary vectors: pairs near in time and meaning, what is counted or linked over them, and nearest neighbours."""

from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.session import shuffle_width
from newsloom.storage import materialize

#: Vectors of one block: where each pair becomes a row, and where a block gives counts or links alone. Rows leave a block
#: a strip at a time, so both sizes bound vectors, not pairs. Labels alone are counted in larger blocks.
BLOCK, WIDE, LABELS = 8192, 8192, 1 << 17
#: A window has so many blocks before they grow, up to so many times their size: copies of a vector are as many as blocks.
BLOCKS, GROWN = 16, 8
#: Rows of a block that meet the other block at once, and how many of its columns, which a core's cache holds.
STRIP, TILE = 256, 1024
#: Pairs by labels: from so many rows of a side on, rows that meet only partly in time are halved.
LEAF = 256
#: Cosines have six digits: they are counted as whole millionths, so many in one bin.
UNIT, BIN = 1_000_000, 1_000
#: The number of a label that is null.
NO_LABEL = np.iinfo(np.int64).min

#: Indexes of the pairs of a strip in the left and the right block, and their cosines.
Strip = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Rows and columns of two blocks that meet, and which of these pairs do; None: all.
Tile = tuple[slice, slice, np.ndarray | None]


def dated(emb: DataFrame, events: DataFrame) -> DataFrame:
    """``(id, label, x, sec)``: vectors with the time of the event of the same number."""
    when = events.select(F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))
    return emb.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("x")).join(when, "id")


class _Side:
    """The vectors of one block, in order of time."""

    def __init__(self, t: pa.Table):
        t = t.take(pc.sort_indices(t, sort_keys=[("sec", "ascending"), ("id", "ascending")]))
        self.id, self.sec = (t.column(c).to_numpy() for c in ("id", "sec"))
        self.label = t.column("label").combine_chunks()
        self._x = t.column("x").combine_chunks() if "x" in t.column_names else None

    @cached_property
    def x(self) -> np.ndarray:
        return self._x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(self.id), -1)

    @cached_property
    def norm(self) -> np.ndarray:
        return np.sqrt((self.x * self.x).sum(1))

    @cached_property
    def codes(self) -> np.ndarray:
        """Labels as numbers; no label is the least."""
        return self.label.cast(pa.int64()).fill_null(NO_LABEL).to_numpy(zero_copy_only=False)

    @cached_property
    def tag(self) -> np.ndarray:
        """Labels to be compared, no label as 0, in as few bytes as hold them."""
        out = self.label.fill_null(0).to_numpy(zero_copy_only=False)
        return out.astype(np.int16) if not len(out) or np.abs(out.astype(np.int64)).max() < 1 << 15 else out

    @cached_property
    def plain(self) -> bool:
        """Whether products of ``unit`` are within ``margin`` of the cosines."""
        return bool((np.isfinite(self.norm) & (self.norm < 1e15) & ((self.norm == 0) | (self.norm >= 1e-2))).all())

    @cached_property
    def unit(self) -> np.ndarray:
        """Vectors of length one in single precision."""
        return (self.x / np.where(self.norm > 0, self.norm, 1)[:, None]).astype(np.float32)

    @property
    def margin(self) -> float:
        """Twice the error of a product in single precision, and what the sixth digit and 1e-10 in the quotient change."""
        return (self.x.shape[1] + 8) * 2.0**-23 + 2e-6


def _tiles(a: _Side, b: _Side, width: int) -> Iterator[Tile]:
    """The pairs of two blocks, or of one with itself, each once; tiles whose pairs all meet need no mask."""
    alone, n = a is b, len(a.id)
    twice = len(np.unique(a.id)) < n if alone else bool(np.isin(a.id, b.id).any())
    for at in range(0, n, STRIP):
        rows = slice(at, min(at + STRIP, n))
        sec = a.sec[rows]
        low, first = np.searchsorted(b.sec, [sec[0] - width, sec[-1] - width], "left").tolist()
        last, high = np.searchsorted(b.sec, [sec[0] + width, sec[-1] + width], "right").tolist()
        if alone:
            low, first = max(low, at), max(first, rows.stop)
        parts = [(low, first, False), (first, last, True), (last, high, False)] if first < last and not twice else [(low, high, False)]
        for begin, end, whole in parts:
            for c in range(begin, end, TILE):
                cols, ok = slice(c, min(c + TILE, end)), None
                if not whole:
                    ok = (np.abs(sec[:, None] - b.sec[None, cols]) <= width) & (a.id[rows, None] != b.id[None, cols])
                    if alone:
                        ok &= np.arange(rows.start, rows.stop)[:, None] < np.arange(cols.start, cols.stop)[None, :]
                    if not ok.any():
                        continue
                yield rows, cols, ok


def _where(hit: np.ndarray) -> np.ndarray:
    """Flat places of the few that are true, looked for eight at a time."""
    flat = hit.ravel()
    n = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:n].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.r_[at[flat[at]], n + np.flatnonzero(flat[n:])]


def _cosines(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of single pairs."""
    return np.round(np.einsum("ij,ij->i", a.x[i], b.x[j]) / (a.norm[i] * b.norm[j] + 1e-10), 6)


def _millionths(a: _Side, b: _Side, rows: slice, cols: slice) -> np.ndarray:
    """Cosines of all pairs of a tile in whole millionths."""
    out = a.x[rows] @ b.x[cols].T
    length = a.norm[rows, None] * b.norm[None, cols]
    length += 1e-10
    out /= length
    out *= UNIT
    return np.rint(out, out=out)


def _picked(a: _Side, b: _Side, tile: Tile, low: float, high: float = 2.0) -> Strip:
    """The pairs of a tile with cosines from ``low`` to ``high``: single precision leaves few to be looked at."""
    rows, cols, ok = tile
    if a.plain and b.plain:
        rough = a.unit[rows] @ b.unit[cols].T
        hit = rough >= np.float32(low - a.margin)
        if high < 1:
            hit &= rough <= np.float32(high + a.margin)
        if ok is not None:
            hit &= ok
    else:
        hit = np.ones((rows.stop - rows.start, cols.stop - cols.start), bool) if ok is None else ok
    p, q = np.divmod(_where(hit), hit.shape[1])
    if len(p) * 16 <= hit.size:
        cos = _cosines(a, b, p + rows.start, q + cols.start)
    else:
        cos = _millionths(a, b, rows, cols)[p, q] / UNIT
    kept = (cos >= low) & (cos <= high)
    return p[kept] + rows.start, q[kept] + cols.start, cos[kept]


def _strips(a: _Side, b: _Side, width: int, least: float | None) -> Iterator[Strip]:
    """The pairs of two blocks, a strip of the left one at a time, each pair once."""
    for _, tiles in groupby(_tiles(a, b, width), key=lambda tile: tile[0].start):
        parts = []
        for rows, cols, ok in tiles:
            if least is not None:
                parts.append(_picked(a, b, (rows, cols, ok), least))
                continue
            cos = _millionths(a, b, rows, cols)
            p, q = np.divmod(np.arange(cos.size) if ok is None else np.flatnonzero(ok), cos.shape[1])
            parts.append((p + rows.start, q + cols.start, (cos.ravel() if ok is None else cos[ok]) / UNIT))
        yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))


#: What two blocks give (one block with itself: the same twice), for pairs so many seconds apart.
Meet = Callable[[_Side, _Side, int], Iterator[pa.Table]]


def _met(rows: DataFrame, hours: int, least: float | None, block: int, of: Callable[[_Side, _Side, Iterator[Strip]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """What ``of`` gives for the strips of each two blocks whose vectors may be at most so many hours apart."""
    return _dealt(rows, hours, block, lambda a, b, width: of(a, b, _strips(a, b, width, least)), schema)


def _dealt(rows: DataFrame, hours: int, block: int, of: Meet, schema: str) -> DataFrame:
    """What ``of`` gives for each two blocks whose vectors may be at most so many hours apart.

    An interval join as an equi-join: time is cut into windows of that length, each window is dealt into as many blocks
    as its own rows ask for, and a block meets itself, the later ones of its window and those of the next window, each
    two in a group of their own: a pair meets once, and no window meets all others. A vector is copied once for each
    block it meets; beyond ``BLOCKS`` blocks of a window it is the blocks that grow, to ``GROWN`` times their size.
    What ``of`` yields is handed on at once, so a group holds the vectors of two blocks and the rows of a strip.
    """
    width = hours * 3600
    plain = [c for c in ("id", "label", "sec", "x") if c in rows.columns]
    rows = materialize(rows.select(*plain), "dated", free=False).withColumn("w", F.floor(F.col("sec") / width))
    few = F.least(F.ceil(F.col("m") / block), F.lit(BLOCKS))
    size = rows.groupBy("w").agg(F.count("*").alias("m")).select("w", F.greatest(few, F.ceil(F.col("m") / (block * GROWN))).cast("int").alias("n"))
    near = size.alias("s")
    for step, name in ((-1, "before"), (1, "after")):
        near = near.join(size.select((F.col("w") - step).alias("w"), F.col("n").alias(name)), "w", "left")
    dealt = rows.join(near, "w").withColumn("at", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    # Groups (window, left block, windows between, right block) of a row, on the left or on the right.
    blocks = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda w, i, k, j, side: F.struct(w.alias("w"), i.alias("i"), F.lit(k).alias("k"), j.alias("j"), F.lit(side).alias("side"))
    w, at = F.col("w"), F.col("at")
    groups = F.concat(
        F.transform(F.sequence(at, F.col("n") - 1), lambda j: group(w, at, 0, j, 0)),
        F.transform(F.filter(blocks("n"), lambda i: i < at), lambda i: group(w, i, 0, at, 1)),
        F.transform(blocks("after"), lambda j: group(w, at, 1, j, 0)),
        F.transform(blocks("before"), lambda i: group(w - 1, i, 1, at, 1)),
    )
    sides = dealt.select(*plain, F.explode(groups).alias("g")).select("g.*", *plain)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i, k, j = (t.column(c)[0].as_py() for c in ("i", "k", "j"))
        a, b = (t.filter(pc.equal(t.column("side"), s)) for s in (0, 1))
        if a.num_rows and (b.num_rows or not k and i == j):
            left = _Side(a)
            for out in of(left, _Side(b) if b.num_rows else left, width):
                yield from out.combine_chunks().to_batches()

    keys = ["w", "i", "k", "j"]
    return sides.repartition(shuffle_width(rows.sparkSession), *keys).groupBy(*keys).applyInArrow(meet, schema)


def near_in_time(rows: DataFrame, hours: int, least: float | None = None, labels: bool = True) -> DataFrame:
    """``(a, b, label_a, label_b, cos)`` of the pairs at most so many hours apart, a < b; those of ``least`` or more alone if given.

    Without ``labels``: ``(a, b, cos)``. The pairs themselves are as many as the windows hold; ``near_bins``,
    ``near_labels`` and ``near_links`` make no row for each.
    """
    names, kinds = ["a", "b", "label_a", "label_b", "cos"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]

    def of(a: _Side, b: _Side, strips: Iterator[Strip]) -> Iterator[pa.Table]:
        for p, q, cos in strips:
            i, j = a.id[p], b.id[q]
            ends = [pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))]
            if not labels:
                yield pa.table([*ends, pa.array(cos)], names=["a", "b", "cos"])
                continue
            swap = pa.array(i > j)
            la, lb = a.label.take(pa.array(p)), b.label.take(pa.array(q))
            columns = [*ends, pc.if_else(swap, lb, la), pc.if_else(swap, la, lb), pa.array(cos)]
            yield pa.table([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return _met(rows, hours, least, BLOCK, of, "a long, b long, label_a int, label_b int, cos double" if labels else "a long, b long, cos double")


def _forest(a: _Side, b: _Side, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the pairs of two blocks with ``least`` or more: at most one for each vector.

    Pairs of vectors that are linked already are not looked at: rows of the largest component meet only what is not in it.
    """
    ids, inverse = np.unique(np.r_[a.id, b.id], return_inverse=True)
    of_a, of_b = inverse[: len(a.id)], inverse[len(a.id) :]
    root = np.arange(len(ids))
    for rows, cols, ok in _tiles(a, b, width):
        left, right = root[of_a[rows]], root[of_b[cols]]
        values, n = np.unique(right, return_counts=True)
        main = values[n.argmax()]
        if (left == main).all() and (right == main).all():
            continue
        p, q, _ = _picked(a, b, (rows, cols, ok), least)
        left, right = root[of_a[p]], root[of_b[q]]
        fresh = np.flatnonzero(left != right)
        while len(fresh):  # each round hangs every such root on the smallest that it meets
            low, high = np.minimum(left[fresh], right[fresh]), np.maximum(left[fresh], right[fresh])
            up = np.arange(len(ids))
            np.minimum.at(up, high, low)
            while (up[up] != up).any():
                up = up[up]
            root = up[root]
            left, right = root[of_a[p]], root[of_b[q]]
            fresh = fresh[left[fresh] != right[fresh]]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[moved]], ids[moved]


def _of_label(side: _Side, code: int) -> _Side:
    """The rows of one label."""
    mine, out = np.flatnonzero(side.codes == code), object.__new__(_Side)
    out.id, out.sec, out.label = side.id[mine], side.sec[mine], side.label.take(pa.array(mine))
    out.x, out.norm = side.x[mine], side.norm[mine]
    return out


def near_links(rows: DataFrame, hours: int, least: float, same_label: bool = False) -> DataFrame:
    """``(a, b)``: links whose components are those of the pairs of ``near_in_time``, of equal labels alone if asked for.

    Each two blocks give a forest: at most a link for each of their vectors, however many pairs they hold.
    """

    def of(a: _Side, b: _Side, width: int) -> Iterator[pa.Table]:
        pairs = [(a, b)]
        if same_label:
            shared = np.intersect1d(a.codes, b.codes)
            cut = ((_of_label(a, c), None if a is b else _of_label(b, c)) for c in shared[shared != NO_LABEL].tolist())
            pairs = ((one, one if two is None else two) for one, two in cut)
        for one, two in pairs:
            yield pa.table([pa.array(e, pa.int64()) for e in _forest(one, two, width, least)], names=["a", "b"])

    return _dealt(rows, hours, WIDE, of, "a long, b long")


class _LabelCounts:
    """Pairs of two blocks by labels, that of the smaller id first, from the places of ids in each other's order."""

    def __init__(self, a: _Side, b: _Side):
        self.a, self.b = a, b
        self.codes, place = np.unique(np.r_[a.codes, b.codes], return_inverse=True)
        self.in_a, self.in_b = place[: len(a.id)], place[len(a.id) :]
        self.parts: list[tuple] = []

    def add(self, cell: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((cell, n))
        if len(self.parts) >= 4096:
            self.parts = [self.sums()]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        cell, n = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        cell, at = np.unique(cell, return_inverse=True)
        return cell, np.bincount(at, n, len(cell)).astype(np.int64)  # below 2^53

    def all(self, rows: slice, cols: slice) -> None:
        """All pairs of these rows with these columns; of a block with itself, each once."""
        k, alone = len(self.codes), self.a is self.b
        order = np.argsort(self.a.id[rows], kind="stable")
        ids, mine, other = self.a.id[rows][order], self.in_a[rows][order], self.in_b[cols]
        before = np.searchsorted(ids, self.b.id[cols], "left")
        upto = np.searchsorted(ids, self.b.id[cols], "right")
        for x in np.unique(mine).tolist():
            sum_to = np.r_[0, np.cumsum(mine == x)]
            less = np.bincount(other, sum_to[before])
            y = np.flatnonzero(less)
            self.add(x * k + y, less[y])
            if not alone:
                more = np.bincount(other, sum_to[-1] - sum_to[upto])
                y = np.flatnonzero(more)
                self.add(y * k + x, more[y])

    def some(self, rows: slice, cols: slice, width: int) -> None:
        """The pairs that are near in time, in a small part."""
        a, b, k = self.a, self.b, len(self.codes)
        for at in range(cols.start, cols.stop, TILE):
            part = slice(at, min(at + TILE, cols.stop))
            p, q = np.nonzero((np.abs(a.sec[rows, None] - b.sec[None, part]) <= width) & (a.id[rows, None] != b.id[None, part]))
            x, y = self.in_a[rows][p], self.in_b[part][q]
            self.add(*np.unique(np.where(a.id[rows][p] > b.id[part][q], y * k + x, x * k + y), return_counts=True))

    def near(self, width: int) -> None:
        """Blocks of one window meet whole; a block of the next one meets what is late enough, by halves."""
        a, b = self.a, self.b
        begin = np.searchsorted(a.sec, b.sec - width, "left")  # grows with time, as both are in order
        end = int(np.searchsorted(b.sec, a.sec[0] - width, "left"))
        if end or a.sec[-1] - b.sec[0] > width:
            raise ValueError("the left block is in the same window or the one before")
        todo = [(0, len(a.id), 0, len(b.id))]
        while todo:
            low, high, first, last = todo.pop()
            whole = first + int(np.searchsorted(begin[first:last], low, "right"))
            last = first + int(np.searchsorted(begin[first:last], high, "left"))
            if whole > first:
                self.all(slice(low, high), slice(first, whole))
            if last <= whole:
                continue
            if high - low <= LEAF:
                self.some(slice(low, high), slice(whole, last), width)
                continue
            mid = (low + high) // 2
            cut = whole + int(np.searchsorted(begin[whole:last], mid, "left"))
            if cut > whole:
                self.all(slice(mid, high), slice(whole, cut))
                todo.append((low, mid, whole, cut))
            todo.append((mid, high, cut, last))


def near_labels(rows: DataFrame, hours: int) -> DataFrame:
    """``(label_a, label_b, n)``: how many pairs of ``near_in_time`` have these labels, that of the smaller id first.

    Vectors are not read, and no pair is formed: time is linear in a block, for each label.
    """

    def of(a: _Side, b: _Side, width: int) -> Iterator[pa.Table]:
        counts = _LabelCounts(a, b)
        counts.near(width)
        cell, n = counts.sums()
        labels = [counts.codes[c] for c in np.divmod(cell, len(counts.codes))]
        yield pa.table([*(pa.array(c, pa.int32(), mask=c == NO_LABEL) for c in labels), pa.array(n, pa.int64())], names=["label_a", "label_b", "n"])

    met = _dealt(rows.drop("x"), hours, LABELS, of, "label_a int, label_b int, n long")
    return met.groupBy("label_a", "label_b").agg(F.sum("n").alias("n"))


def _verdicts(a: _Side, b: _Side, tile: Tile) -> tuple[np.ndarray, np.ndarray | None]:
    """Which pairs of a tile have equal labels; which have one without a label (None: no pair)."""
    rows, cols, _ = tile
    same, out = a.tag[rows, None] == b.tag[None, cols], (a.codes[rows] == NO_LABEL, b.codes[cols] == NO_LABEL)
    if not out[0].any() and not out[1].any():
        return same, None
    unknown = out[0][:, None] | out[1][None, :]
    return same & ~unknown, unknown


def _verdict_table(columns: list[np.ndarray], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    """Columns of which the first is a verdict: 2 is none."""
    arrays = [pa.array(columns[0] == 1, pa.bool_(), mask=columns[0] == 2)]
    return pa.table([*arrays, *(pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns[1:], kinds, strict=True))], names=names)


def _reached(edges: list[float]) -> Meet:
    """``(verdict, bin, n)``: single precision decides, but for cosines next to an edge."""

    def of(a: _Side, b: _Side, width: int) -> Iterator[pa.Table]:
        n = np.zeros((3, len(edges) + 1), np.int64)  # by verdict: pairs, and those that reach each edge
        rough = a.plain and b.plain
        for tile in _tiles(a, b, width):
            rows, cols, ok = tile
            same, unknown = _verdicts(a, b, tile)
            value = a.unit[rows] @ b.unit[cols].T if rough else _millionths(a, b, rows, cols) / UNIT
            if not rough:
                ok = ~np.isnan(value) if ok is None else ok & ~np.isnan(value)

            def count(at: int, hit: np.ndarray | None) -> None:
                hit = hit if ok is None else ok if hit is None else hit & ok
                total = same.size if hit is None else np.count_nonzero(hit)
                equal = np.count_nonzero(same if hit is None else same & hit)
                none = 0 if unknown is None else np.count_nonzero(unknown if hit is None else unknown & hit)
                n[:, at] += (total - equal - none, equal, none)

            count(0, None)
            for at, edge in enumerate(edges, 1):
                if not rough:
                    count(at, value >= edge)
                    continue
                sure = value >= np.float32(edge + a.margin)
                p, q = np.divmod(_where(sure ^ (value >= np.float32(edge - a.margin))), sure.shape[1])
                if len(p) * 16 <= sure.size:
                    sure[p, q] = _cosines(a, b, p + rows.start, q + cols.start) >= edge
                else:
                    sure = _millionths(a, b, rows, cols) / UNIT >= edge
                count(at, sure)
        n = n - np.c_[n[:, 1:], np.zeros((3, 1), np.int64)]
        verdict, at = np.nonzero(n)
        yield _verdict_table([verdict, at, n[verdict, at]], ["verdict", "bin", "n"], [pa.int64()] * 2)

    return of


def _single(fine: list[tuple[bool | None, int]]) -> Meet:
    """``(verdict, bin, n)`` of the pairs in a few bins, each millionth as a bin of its own."""
    asked = {b: [2 if v is None else int(v) for v, c in fine if c == b] for _, b in fine}

    def of(a: _Side, b: _Side, width: int) -> Iterator[pa.Table]:
        counts = {(v, bin_): np.zeros(BIN, np.int64) for bin_, verdicts in asked.items() for v in verdicts}
        for tile in _tiles(a, b, width):
            for bin_, verdicts in asked.items():
                p, q, cos = _picked(a, b, tile, bin_ * BIN / UNIT, (bin_ * BIN + BIN - 1) / UNIT)
                one, two = a.codes[p], b.codes[q]
                verdict = np.where((one == NO_LABEL) | (two == NO_LABEL), 2, one == two)
                at = np.rint(cos * UNIT).astype(np.int64) - bin_ * BIN
                for v in verdicts:
                    counts[v, bin_] += np.bincount(at[verdict == v], minlength=BIN)
        for (v, bin_), n in counts.items():
            at = np.flatnonzero(n)
            yield _verdict_table([np.full(len(at), v), at + bin_ * BIN, n[at]], ["verdict", "bin", "n"], [pa.int64()] * 2)

    return of


def _thousandths(a: _Side, b: _Side, width: int) -> Iterator[pa.Table]:
    """What ``near_bins`` counts without edges. Of unequal labels are the pairs that are left."""
    top, rough = UNIT // BIN, a.plain and b.plain
    n, total, squares = np.zeros((3, 2 * top + 1), np.int64), [0, 0, 0], [0.0, 0.0, 0.0]
    low, high = [np.inf] * 3, [-np.inf] * 3
    for tile in _tiles(a, b, width):
        rows, cols, ok = tile
        value, (same, unknown) = _millionths(a, b, rows, cols), _verdicts(a, b, tile)
        if not rough:
            ok = ~np.isnan(value) if ok is None else ok & ~np.isnan(value)
        pick = (lambda x: x.ravel()) if ok is None else (lambda x, ok=ok: x[ok])
        value, same = pick(value), pick(same)
        other = same if unknown is None else same | pick(unknown)
        if not len(value):
            continue
        for v, x, sign in ((0, value, 1), (1, value[same], -1), *(((2, value[pick(unknown)], -1),) if unknown is not None else ())):
            if not len(x):
                continue
            hist = np.bincount(((x + (top * BIN + 0.5)) * (1 / BIN)).astype(np.int64), minlength=2 * top + 1)
            sums = int(x.sum()), float(x @ x)
            for u, by in ((v, 1), (0, sign)) if v else ((0, 1),):
                n[u] += by * hist
                total[u] += by * sums[0]
                squares[u] += by * sums[1]
            for ends, end, better in ((low, np.min, np.less), (high, np.max, np.greater)):
                if better(end(x), ends[v]):
                    mine = x if v else x[~other]  # looked for only where it may be a new end
                    ends[v] = end(mine, initial=ends[v])
    verdict, at = np.nonzero(n)
    first = np.diff(verdict, prepend=-1) > 0
    once = lambda x: np.where(first, np.array(x)[verdict], 0)
    ends = [np.array(e)[verdict] for e in (low, high)]
    kinds = [*[pa.int64()] * 3, pa.float64(), *[pa.int64()] * 2]
    yield _verdict_table([verdict, at - top, n[verdict, at], once(total), once(squares), *ends], ["verdict", "bin", "n", "total", "squares", "low", "high"], kinds)


def near_bins(rows: DataFrame, hours: int, edges: list[float] | None = None, fine: list[tuple[bool | None, int]] | None = None) -> DataFrame:
    """``(verdict, bin, n)`` of the pairs of ``near_in_time``, counted where they meet.

    ``verdict``: whether the labels are equal, null without one. ``bin`` is how many ``edges`` (ascending) a cosine
    reaches. With ``fine``, pairs (verdict, bin), only pairs in those thousandths are counted, each millionth as a bin
    of its own. With neither, it is the thousandth, rounded down, and ``(total, squares, low, high)`` follow, of cosines in
    millionths: sums over the bins of a verdict give ``total`` (exact) and ``squares``; its ends are in each of its bins.
    """
    if edges is not None or fine is not None:
        met = _dealt(rows, hours, WIDE, _reached(list(edges)) if edges is not None else _single(fine), "verdict boolean, bin long, n long")
        return met.groupBy("verdict", "bin").agg(F.sum("n").alias("n"))
    met = _dealt(rows, hours, WIDE, _thousandths, "verdict boolean, bin long, n long, total long, squares double, low long, high long")
    exact = F.sum(F.col("total").cast("decimal(20,0)")).alias("total")
    return met.groupBy("verdict", "bin").agg(F.sum("n").alias("n"), exact, F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))


def near_stats(rows: DataFrame, hours: int) -> DataFrame:
    """``(verdict, n, mean, median, stdev, low, high)`` of the cosines of pairs with equal labels, of others, and of those without.

    The median is exact: the first pass counts bins, the second the values in the bins that hold the middle ranks.
    """
    counted = materialize(near_bins(rows, hours), "bins", free=False)
    total, one, root = F.sum("total").cast("double"), F.lit(float(UNIT)), F.sum("n").cast("double")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum("squares") - total * total / root) / F.when(root > 1, root - 1)) / one
    plain = counted.groupBy("verdict").agg(
        F.sum("n").alias("n"), F.round(total / root / one, 5).alias("mean"), F.round(spread, 5).alias("stdev"), (F.min("low") / one).alias("low"), (F.max("high") / one).alias("high"))
    upto = Window.partitionBy("verdict").orderBy("bin")
    placed = counted.select("verdict", "bin", "n", F.sum("n").over(upto).alias("to"), F.sum("n").over(Window.partitionBy("verdict")).alias("all"))
    ranks = lambda c: c.where("(`all` + 1) div 2 > to - n AND (`all` + 1) div 2 <= to OR `all` div 2 + 1 > to - n AND `all` div 2 + 1 <= to")
    middle = ranks(placed).select("verdict", "bin", (F.col("to") - F.col("n")).alias("before"), "all").collect()
    if not middle:
        return plain.select("verdict", "n", "mean", F.lit(None).cast("double").alias("median"), "stdev", "low", "high")
    fine = near_bins(rows, hours, fine=[(r["verdict"], r["bin"]) for r in middle]).select("verdict", F.col("bin").alias("value"), "n")
    known = rows.sparkSession.createDataFrame([tuple(r) for r in middle], "verdict boolean, bin long, before long, `all` long")
    fine = fine.withColumn("bin", F.floor(F.col("value") / BIN)).withColumnRenamed("verdict", "v").withColumnRenamed("bin", "f")
    within = Window.partitionBy("verdict", "bin").orderBy("value")
    values = fine.join(F.broadcast(known), F.col("v").eqNullSafe(F.col("verdict")) & (F.col("f") == F.col("bin")))
    values = values.select("verdict", "value", "n", "all", (F.col("before") + F.sum("n").over(within)).alias("to"))
    median = ranks(values).groupBy("verdict").agg(F.round((F.min("value") + F.max("value")) / 2.0 / one, 5).alias("median")).withColumnRenamed("verdict", "v")
    return plain.join(median, F.col("verdict").eqNullSafe(F.col("v")), "left").select("verdict", "n", "mean", "median", "stdev", "low", "high")


def nearest(emb: DataFrame, vector: list[float], k: int) -> DataFrame:
    """``(vec_id, label, cos)`` of the k rows closest to ``vector``: one scan, top k kept in every task."""
    query = F.array(*[F.lit(float(v)) for v in vector])
    rows = emb.select("vec_id", "label", F.round(T.cosine(F.col("embedding"), query), 6).alias("cos"))
    return rows.orderBy(F.desc("cos"), "vec_id").limit(k)
