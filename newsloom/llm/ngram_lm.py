"""Language-model scores by deleted interpolation.

The model mixes three maximum-likelihood estimates of the next token: by the pair with its predecessor, by the token
alone, and uniform. The mixture depends on how often the context was seen, in buckets of powers of two, and its
weights come from expectation-maximisation on counts of held-out training documents, which the estimates of that step
leave out. The final scores use the counts of all training documents.

Counts are gathered by ``chunks``: every chunk asks for its own distinct tokens and pairs. For the mixture weights a
chunk returns a histogram of how the estimates of its held-out pairs compare, on a fixed grid of log-ratios with the
mean of each cell, so the driver gets a table whose size does not depend on the corpus.
"""

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import chunks
from newsloom.storage import materialize

#: Keys: tokens by their hash, the end of a text and the start that precedes it by hashes of their own.
END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
BUCKETS = 24
#: Cells of a tenth of a decade between -10 and 10, and one beside them for an estimate of nothing.
GRID, STEP = 201, 0.1
TRAIN_SPLIT, HELD_OUT = 7, 2
#: Of the training rows, those with this remainder set the weights.
TUNE = 3


def part_of(doc_id: int | None) -> int:
    """0: held out of training; 1: counted for the estimates; 2: counted too, and held out while weights are set. A null id is 1."""
    if doc_id is None:
        return 1
    rest = zlib.crc32(str(doc_id).encode()) % TRAIN_SPLIT
    return 0 if rest == HELD_OUT else 2 if rest == TUNE else 1


class _Tokens:
    """A chunk's tokens: local numbers of each document, and each number's hash."""

    def __init__(self, docs: Iterator, only: int | None = None):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        self.ids, self.parts, self.texts = [], [], []
        for doc_id, text in docs:
            part = part_of(doc_id)
            if only is not None and part != only:
                continue
            words = text.lower().split()
            self.ids.append(doc_id)
            self.parts.append(part)
            self.texts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
        n = len(number)
        self.hashes = np.r_[hashed, END, START]
        self.end, self.start = n, n + 1

    def sequences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens in order: the number of the document, the context, the token."""
        sizes = np.array([len(t) + 1 for t in self.texts], np.int64)
        own = np.repeat(np.arange(len(sizes)), sizes)
        if not len(sizes):
            return own, own, own
        token = np.concatenate([np.r_[t, self.end] for t in self.texts])
        context = np.r_[self.start, token[:-1]]
        context[np.r_[0, np.cumsum(sizes)[:-1]]] = self.start
        return own, context, token

    def pair_keys(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        return chunks.mix64(self.hashes[context] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[token])

    def token_keys(self) -> np.ndarray:
        """Keys of the chunk's tokens by number, the end and the start being the last two."""
        return _token_key(self.hashes)


def _token_key(h: np.ndarray) -> np.ndarray:
    return chunks.mix64(h)


def _counted(keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Distinct keys with their counts in the two training parts; keys of held-out texts alone have 0."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, {f"c{k}": _small(np.bincount(inverse, part == k, len(distinct))) for k in (1, 2)}


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def _request(parts: int):
    def request(g: int, docs: Iterator, _: dict) -> list:
        tokens = _Tokens(docs)
        own, context, token = tokens.sequences()
        part = np.array(tokens.parts, np.int64)
        pairs = chunks.part_rows(g, parts, *_counted(tokens.pair_keys(context, token), part[own]), kind=0, kinds=2)
        # The start is not a token, but as a context it is counted, once for each text.
        started = np.r_[token, np.full(len(part), tokens.start)]
        counted = _counted(tokens.token_keys()[started], np.r_[part[own], part])
        return pairs + chunks.part_rows(g, parts, *counted, kind=1, kinds=2)

    return request


def _merge(kind: int):
    """Counts in all training texts for every entry; without those that set the weights, for the entries they hold."""

    def merge(distinct: np.ndarray, inverse: np.ndarray, columns: dict) -> dict:
        c1, c2 = (np.bincount(inverse, columns[n], len(distinct)).astype(np.int64) for n in ("c1", "c2"))
        return {kind: ({"c": _small(c1 + c2)[inverse]}, None), kind + 2: ({"c": _small(c1)[inverse]}, columns["c2"] > 0)}

    return merge


def _totals(kind: int, distinct: np.ndarray, inverse: np.ndarray, columns: dict) -> bytes | None:
    """Of a partition of tokens: how many there are in either training part, and how many different ones."""
    if kind == 0:
        return None
    real = distinct != _token_key(np.array([START]))[0]
    c1, c2 = (np.bincount(inverse, columns[n], len(distinct)).astype(np.int64)[real] for n in ("c1", "c2"))
    return np.array([c1.sum(), c2.sum(), (c1 > 0).sum(), (c1 + c2 > 0).sum()], np.int64).tobytes()


def _looked_up(tokens: _Tokens, context: np.ndarray, token: np.ndarray, replies: dict, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the pair, the context and the token: of all training texts (kind 0) or without some (kind 2)."""
    pair_keys, pair_at = np.unique(tokens.pair_keys(context, token), return_inverse=True)
    keys, at = np.unique(tokens.token_keys(), return_inverse=True)
    pair, of_token = replies[kind]["c"].astype(np.int64)[pair_at], replies[kind + 1]["c"].astype(np.int64)[at]
    return pair, of_token[context], of_token[token]


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the power of two below the count, at most BUCKETS - 1."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


def _histogram(n: int, v: int):
    """Rows ``(bucket, cell of pair over token, cell of uniform over token, n, sums of the logs)`` of a chunk."""

    def final(g: int, docs: Iterator, replies: dict) -> pa.Table:
        tokens = _Tokens(docs, only=2)
        own, context, token = tokens.sequences()
        names = ["cell", "n", "s2", "s1"]
        if not len(token):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        pair, seen, alone = _looked_up(tokens, context, token, replies, 2)
        base = math.log10(1 / (v + 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            r2 = np.where(pair > 0, np.log10(pair / np.maximum(seen, 1)) - base, np.nan)
            r1 = np.where(alone > 0, np.log10(alone / max(n, 1)) - base, np.nan)
        at = lambda r: np.where(np.isnan(r), GRID, np.clip(np.rint(np.nan_to_num(r) / STEP) + GRID // 2, 0, GRID - 1)).astype(np.int64)
        cell = (bucket(seen).astype(np.int64) * (GRID + 1) + at(r2)) * (GRID + 1) + at(r1)
        distinct, inverse = np.unique(cell, return_inverse=True)
        sums = [np.bincount(inverse, np.nan_to_num(r), len(distinct)) for r in (r2, r1)]
        return pa.table([pa.array(distinct), pa.array(np.bincount(inverse, minlength=len(distinct)).astype(np.int64)), *map(pa.array, sums)], names=names)

    return final


def learn_weights(cells: np.ndarray, n: np.ndarray, s2: np.ndarray, s1: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights (pair, token, uniform) of each bucket by expectation-maximisation; a bucket without held-out
    counts takes those of the nearest lower bucket that has some, bucket 0 never the pair's."""
    own, at2, at1 = cells // (GRID + 1) ** 2, cells // (GRID + 1) % (GRID + 1), cells % (GRID + 1)
    like = np.stack([np.where(at2 < GRID, 10.0 ** (s2 / n), 0), np.where(at1 < GRID, 10.0 ** (s1 / n), 0), np.ones(len(n))], axis=1)
    out = np.empty((BUCKETS, 3))
    last = np.array([0.0, 0.9, 0.1])
    for b in range(BUCKETS):
        mine = own == b
        if mine.any():
            w = np.array([0.5, 0.4, 0.1]) if b else np.array([0.0, 0.9, 0.1])
            for _ in range(rounds):
                share = like[mine] * w
                share *= (n[mine] / share.sum(axis=1))[:, None]
                w = share.sum(axis=0) + np.array([1e-3 * (b > 0), 1e-3, 1e-3])
                w /= w.sum()
            last = w
        out[b] = last if b else np.array([0.0, *(last[1:] / last[1:].sum())])
    return out


def _score(n: int, v: int, weights: np.ndarray):
    def final(g: int, docs: Iterator, replies: dict) -> pa.Table:
        tokens = _Tokens(docs)
        own, context, token = tokens.sequences()
        size = len(tokens.ids)
        if size:
            pair, seen, alone = _looked_up(tokens, context, token, replies, 0)
            w = weights[bucket(seen)]
            p = w[:, 0] * pair / np.maximum(seen, 1) + w[:, 1] * alone / max(n, 1) + w[:, 2] / (v + 1)
            score = np.bincount(own, np.log10(p), size)
            base = np.bincount(own, np.log10(alone + 1) - math.log10(n + v + 1), size)
            known, tally = np.bincount(own, alone > 0, size).astype(np.int64), np.bincount(own, minlength=size)
        else:
            score = base = np.empty(0)
            known = tally = np.empty(0, np.int64)
        columns = [
            pa.array(tokens.ids, pa.int64()), pa.array([x == 0 for x in tokens.parts], pa.bool_()), pa.array(tally, pa.int64()),
            pa.array(known, pa.int64()), pa.array(np.full(size, n), pa.int64()), pa.array(base), pa.array(score),
        ]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return final


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row, from whole texts.

    Tokens are words in lower case (A-Z) and one end. A null text counts as empty: it has its end alone. A null doc_id
    is a training row. Rows that repeat each count and are each returned. Without training rows every token is unknown
    and the mixture is uniform. No rows: an empty result.
    """
    parts = chunks.key_parts(docs)
    dealt = chunks.deal(docs, id_col, text_col)
    replies = materialize(chunks.answer(chunks.ask(dealt, _request(parts)), [_merge(0), _merge(1)], totals=_totals), "lm-counts")
    totals = np.array([np.frombuffer(r.block, np.int64) for r in replies.where("kind = -1").select("block").collect()], np.int64).reshape(-1, 4).sum(axis=0)
    n1, n2, v1, v = totals.tolist()
    tune, own = replies.where("kind IN (2, 3)"), replies.where("kind IN (0, 1)")
    # Only texts that set the weights are dealt again for the histogram.
    text_id = F.col(id_col).cast("long").cast("string").cast("binary")
    tuning = chunks.deal(docs.where(F.crc32(text_id) % TRAIN_SPLIT == TUNE), id_col, text_col)
    cells = chunks.finish(tuning, tune, _histogram(n1, v1), "cell long, n long, s2 double, s1 double")
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).orderBy("cell").collect()
    table = np.array([tuple(r) for r in rows], float).reshape(-1, 4)
    weights = learn_weights(table[:, 0].astype(np.int64), table[:, 1], table[:, 2], table[:, 3])
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.finish(dealt, own, _score(n1 + n2, v, weights), schema)

