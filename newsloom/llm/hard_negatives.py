"""Hard negatives for chosen anchors, by dense products of blocks.

Vectors are scaled to integers once and written. The anchors come in passes of bounded bytes; a pass is broadcast, and
every Arrow batch of vectors is one candidate block: its product with a block of anchors is one matrix product in
float64, which is exact while all sums stay under 2^53 (checked for each pair of blocks; beyond, the product is taken
in 64-bit integers). A task keeps the best few of each anchor and hands those on, so what is shuffled does not grow
with the pairs; the tasks' lists are merged by rank.

The first product finds each anchor's positives. Their scores give the windows in which the second one looks for
negatives. Every anchor meets every vector; candidates are never moved for it, copied or sampled.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import shuffle_width
from newsloom.storage import discard, materialize

#: Sums of integers under this are exact in float64.
EXACT = 1 << 53
#: Anchors of one pass, as bytes of their components on the driver and in each worker; more anchors, more passes.
PASS_BYTES = 64 << 20
TILE_ANCHORS, TILE_CANDIDATES = 512, 2048
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Stands for a null id, after all others.
NO_ID = MOST

FOUND = "anchor long, slot int, score long, id long, row long"


class Anchors:
    """Anchors of one length of vector, with the windows of scores to look in."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.rows, self.labels, self.values, self.low, self.high = rows, labels, values, low, high
        self.dense = values.astype(np.float64)
        self.largest = float(np.abs(self.dense).max(initial=0))


def product(a: np.ndarray, b: np.ndarray, dense_a: np.ndarray, dense_b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of all rows: float64 where exact, else integers, held at the ends of 64 bits."""
    near = dense_a @ dense_b.T
    if exact:
        return near
    out = a @ b.T  # wraps, so it is right where the result has 64 bits
    out[near >= MOST] = MOST
    out[near <= LEAST] = LEAST + 1
    return out


class Best:
    """The best ``k`` candidates of each anchor and window so far: higher scores first, ties by smaller id."""

    def __init__(self, anchors: Anchors, k: int, same: bool):
        self.anchors, self.k, self.same = anchors, k, same
        shape = (*anchors.low.shape, k)
        self.score, self.id = np.full(shape, LEAST), np.full(shape, MOST)
        self.row, self.filled = np.zeros(shape, np.int64), np.zeros(shape, bool)

    def take(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        order = np.lexsort((rows, ids))
        rows, ids, labels, values = rows[order], ids[order], labels[order], values[order]
        dense = values.astype(np.float64)
        exact = values.shape[1] * self.anchors.largest * float(np.abs(dense).max(initial=0)) < EXACT
        for c in range(0, len(rows), TILE_CANDIDATES):
            cs = slice(c, c + TILE_CANDIDATES)
            by_row = np.argsort(rows[cs])
            for a in range(0, len(self.anchors.rows), TILE_ANCHORS):
                own = slice(a, a + TILE_ANCHORS)
                scores = product(self.anchors.values[own], values[cs], self.anchors.dense[own], dense[cs], exact)
                fits = (self.anchors.labels[own, None] == labels[None, cs]) == self.same
                at = np.minimum(np.searchsorted(rows[cs], self.anchors.rows[own], sorter=by_row), len(by_row) - 1)
                itself = np.flatnonzero(rows[cs][by_row[at]] == self.anchors.rows[own])
                fits[itself, by_row[at[itself]]] = False
                for slot in range(self.score.shape[1]):
                    self._merge(a, slot, scores, fits, ids[cs], rows[cs])

    def _merge(self, first: int, slot: int, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        own, k = slice(first, first + len(scores)), self.k
        worst, worst_id = self.score[own, slot, -1], self.id[own, slot, -1]
        full = self.filled[own, slot, -1]
        low = np.maximum(self.anchors.low[own, slot], np.where(full, worst, LEAST)).astype(scores.dtype)
        high = self.anchors.high[own, slot].astype(scores.dtype)
        hit = fits & (scores >= low[:, None]) & (scores <= high[:, None])
        many = np.flatnonzero(hit.sum(axis=1) > k)
        if len(many):  # at most k of a block for each anchor, ties by place, which is by id
            part = np.where(hit[many], scores[many], -np.inf if scores.dtype == np.float64 else LEAST)
            kth = np.partition(part, part.shape[1] - k, axis=1)[:, -k, None]
            above, ties = part > kth, (part == kth) & hit[many]
            hit[many] = above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1)[:, None]))
        anchor, at = np.nonzero(hit)
        score, ident = scores[anchor, at].astype(np.int64), ids[at]
        better = ~full[anchor] | (score > worst[anchor]) | (ident < worst_id[anchor])
        anchor, at, score, ident = anchor[better], at[better], score[better], ident[better]
        if not len(anchor):
            return
        touched = np.unique(anchor)
        old = self.filled[first + touched, slot]
        whose = np.r_[np.repeat(touched, old.sum(axis=1)), anchor]
        score = np.r_[self.score[first + touched, slot][old], score]
        ident = np.r_[self.id[first + touched, slot][old], ident]
        row = np.r_[self.row[first + touched, slot][old], rows[at]]
        order = np.lexsort((row, ident, -score, whose))
        whose, score, ident, row = whose[order], score[order], ident[order], row[order]
        begin = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
        rank = np.arange(len(whose)) - np.repeat(begin, np.diff(np.r_[begin, len(whose)]))
        keep = rank < k
        to = (first + whose[keep], slot, rank[keep])
        self.score[to], self.id[to], self.row[to], self.filled[to] = score[keep], ident[keep], row[keep], True

    def batch(self) -> pa.RecordBatch:
        anchor, slot, _ = np.nonzero(self.filled)
        columns = [self.anchors.rows[anchor], slot.astype(np.int32), self.score[self.filled], self.id[self.filled], self.row[self.filled]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "slot", "score", "id", "row"])


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length of vector: the places of its vectors, and their components as one matrix."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        part = vectors if len(at) == len(lengths) else vectors.take(pa.array(at))
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(n)).astype(np.int64, copy=False)


def _best(vectors: DataFrame, anchors: list[Anchors], k: int, same: bool) -> DataFrame:
    """Each anchor's and window's best ``k`` of all vectors, in order, with ``rank`` from 1."""
    shared = vectors.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {a.values.shape[1]: Best(a, k, same) for a in shared.value}
        for batch in batches:
            rows, ids, labels = (batch.column(i).to_numpy() for i in range(3))
            for at, values in _matrices(batch.column(3)):
                if values.shape[1] in best:
                    best[values.shape[1]].take(rows[at], ids[at], labels[at], values)
        for found in best.values():
            yield found.batch()

    found = vectors.repartition(shuffle_width(vectors.sparkSession)).mapInArrow(run, FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _anchors(rows: DataFrame, slots: int, low: tuple[int, int], high: tuple[int, int]) -> list[Anchors]:
    """The anchors of one pass, brought to the driver, with the windows that ``scores`` of positives give."""
    table = rows.toArrow()
    vectors = table.column("v").combine_chunks()
    keys, labels = (table.column(c).to_numpy() for c in ("row", "label"))
    lows, highs = np.full((len(keys), slots), MOST), np.full((len(keys), slots), LEAST)
    if "scores" not in table.column_names:
        lows[:], highs[:] = LEAST, MOST
    else:
        for i, scores in enumerate(table.column("scores").to_pylist()):
            # Of p = d q + r: the bounds n p / d, upwards and downwards, without leaving 64 bits.
            (q, r), (s, t) = divmod(np.array(scores), low[1]), divmod(np.array(scores), high[1])
            lows[i, : len(scores)] = low[0] * q - (-low[0] * r // low[1])
            highs[i, : len(scores)] = high[0] * s + high[0] * t // high[1]
    return [Anchors(keys[at], labels[at], values, lows[at], highs[at]) for at, values in _matrices(vectors)] if len(keys) else []


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 10, scale: int = 256, low: tuple[int, int] = (3, 10), high: tuple[int, int] = (9, 10),
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(scale * x)``; a score is the inner product. An anchor's positives are its best rows of
    the same label but itself; for each, the best rows of other labels with a score from ``low`` to ``high`` times the
    positive's are its hard negatives. Ties go by the smaller id; a null id comes last and is returned as null.

    Rows with a null label, a null vector, or a null or non-finite component (as it is or scaled) take no part. Rows
    that repeat are rows of their own. Vectors of different lengths have no score with each other. Scores that do not
    fit 64 bits are held at the ends. An anchor without positives, or a positive without negatives, has no row, and an
    empty table gives none. Labels are integers. Other columns are not read.
    """
    spark = vectors.sparkSession
    x = lambda v: v.cast("double") * scale
    whole = F.forall(vector_col, lambda v: v.isNotNull() & (F.abs(x(v)) < F.lit(float("inf"))))
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & whole).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(label_col).cast("long").alias("label"), F.transform(vector_col, lambda v: F.floor(x(v))).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = materialize(rows, "vectors")
    asked, block = rows.where("is_anchor"), rows.select("row", "id", "label", "v")
    size = asked.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    done = []
    for n in range(passes):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == n)
        best = _best(block, _anchors(own, 1, low, high), positives, True)
        near = materialize(best.join(own.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor"), "positives")
        scores = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score")))["score"].alias("scores"))
        windows = own.join(scores, own["row"] == scores["anchor"])
        far = _best(block, _anchors(windows, positives, low, high), negatives, False)
        pairs = far.select("anchor", (F.col("slot") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        known = near.select("anchor", F.col("rank").alias("place"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        done.append(materialize(pairs.join(known, ["anchor", "place"]), "negatives"))
        discard(near)
    discard(rows)
    null = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return reduce(DataFrame.unionByName, done).select(null("anchor_id"), null("positive_id"), "rank", null("negative_id"), "positive_score", "negative_score")
