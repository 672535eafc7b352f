"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, of which only the bag has a label. Every passage is encoded, gated attention
(Ilse, Tomczak and Welling, 2018) weighs the passages, and the weighted sum of their codes is classified. The model is
a few thousand numbers, fitted in the driver on a bounded sample of labelled documents; scoring is one pass over the
documents in which nothing is shuffled.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE_WORDS = 64
#: So many passages get their features at once, which bounds the arrays that a very long text needs.
BLOCK_PASSAGES = 512
#: Byte classes: each ASCII mark is its own, then lower case, upper case, digits, spaces, controls, bytes above ASCII.
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
CLASSES = len(_MARKS) + 6
N_FEATURES = CLASSES + 4


def _byte_classes() -> np.ndarray:
    of = np.empty(256, np.int64)
    for b in range(256):
        c = chr(b)
        of[b] = (
            _MARKS.index(b) if b in _MARKS
            else len(_MARKS) + (5 if b > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if b == 32 else 4)
        )
    return of


CLASS_OF = _byte_classes()


def passages(text: str | None) -> np.ndarray:
    """Features of each passage of so many words, shape (passages, N_FEATURES); an empty text is one passage of zeros."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    block = BLOCK_PASSAGES * PASSAGE_WORDS
    return np.concatenate([_features(words[at : at + block]) for at in range(0, len(words), block)])


def _features(words: list[bytes]) -> np.ndarray:
    """Features of the passages of some words."""
    starts = range(0, len(words), PASSAGE_WORDS)
    n = len(starts)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    own = np.repeat(np.arange(len(words)) // PASSAGE_WORDS, lengths)
    marks = CLASS_OF[np.frombuffer(b"".join(words), np.uint8)]
    out = np.zeros((n, N_FEATURES), np.float32)
    counts = np.bincount(own * CLASSES + marks, minlength=n * CLASSES).reshape(n, CLASSES)
    size = counts.sum(axis=1, keepdims=True)
    out[:, :CLASSES] = np.sqrt(counts / size)
    per = np.bincount(np.arange(len(words)) // PASSAGE_WORDS)
    out[:, CLASSES] = [len(set(words[s : s + PASSAGE_WORDS])) for s in starts] / per
    out[:, CLASSES + 1] = np.log1p(per) / 5
    out[:, CLASSES + 2] = np.minimum(size[:, 0] / per / 10, 3)
    out[:, CLASSES + 3] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class GatedAttention:
    """Passage codes tanh(x E); attention softmax(tanh(h V) * sigmoid(h U) . w); score sigmoid(sum(a h) . c + b)."""

    code: int = 24
    gate: int = 12
    epochs: int = 150
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p, sizes = self.weights, np.diff(np.r_[starts, len(x)])
        h = np.tanh(x @ p["E"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return sizes, h, t, g, a, z, _sigmoid(z @ p["c"] + p["b"])

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> "GatedAttention":
        """Full-batch Adam on the log-loss. One class alone, or no bags: the score is the labels' mean, or one half."""
        rng, d = np.random.default_rng(self.seed), N_FEATURES
        p = self.weights = {
            "E": rng.normal(0, d**-0.5, (d, self.code)), "V": rng.normal(0, 0.3, (self.code, self.gate)), "U": rng.normal(0, 0.3, (self.code, self.gate)),
            "w": np.zeros(self.gate), "c": np.zeros(self.code), "b": np.zeros(1),
        }
        mean = (labels.sum() + 1) / (len(labels) + 2)
        p["b"][0] = np.log(mean / (1 - mean))
        if len(set(labels.tolist())) < 2:
            return self
        x = np.concatenate(bags).astype(np.float64)
        starts = np.cumsum([0, *map(len, bags[:-1])])
        m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
        for step in range(1, self.epochs + 1):
            sizes, h, t, g, a, z, y = self._forward(x, starts)
            miss = (y - labels) / len(labels)
            dz = np.repeat(miss, sizes)[:, None] * p["c"]
            da = (dz * h).sum(axis=1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
            dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grads = {"E": x.T @ dh, "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ miss, "b": np.array([miss.sum()])}
            for k, grad in grads.items():
                grad = grad + self.decay * p[k] * (k != "b")
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                p[k] -= self.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """The probability of label 1 for each bag."""
        if not bags:
            return np.empty(0)
        return self._forward(np.concatenate(bags).astype(np.float64), np.cumsum([0, *map(len, bags[:-1])]))[-1]


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(doc_id) -> F.Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 by 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_chars: int = 200_000, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> GatedAttention:
    """Fit on at most ``max_docs`` labelled documents of at most ``max_chars`` characters that are not held out.

    The sample is the one with the smallest hashes of doc_id, so it does not depend on order or size of the input.
    A doc_id with several labels counts with the smallest; null labels count as none; of documents that repeat a
    doc_id one is used, that with the smallest bag, so at most ``max_docs`` bags come to the driver.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = _text_rows(docs, id_col, text_col).join(F.broadcast(own), "doc_id").where(F.char_length(F.coalesce("text", F.lit(""))) <= max_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([zlib.compress(b.tobytes()) for b in bags], pa.binary())], ["doc_id", "y", "bag"])

    found = texts.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, bag binary")
    rows = found.groupBy("doc_id", "y").agg(F.min("bag").alias("bag")).collect()
    rows.sort(key=lambda r: r.doc_id)
    bags = [np.frombuffer(zlib.decompress(r.bag), np.float32).reshape(-1, N_FEATURES) for r in rows]
    return GatedAttention().fit(bags, np.array([r.y for r in rows], float))


def _scores(net: GatedAttention, texts: pa.Array) -> np.ndarray:
    """The score of each text, some texts at a time."""
    parts = [net.score([passages(t.as_py()) for t in texts.slice(at, 64)]) for at in range(0, len(texts), 64)]
    return np.concatenate(parts) if parts else np.empty(0)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: GatedAttention | None = None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row, from whole texts.

    A null text counts as empty; an empty text is one passage of zeros and is scored like any other. Without labels of
    both kinds every score is the labels' smoothed mean. Rows that repeat are each returned; no rows: an empty result.
    """
    net = model or train(docs, labels, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(net, batch.column(1)), pa.float64())], ["doc_id", "score"])

    scored = _text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with a score of at least one half, with their columns; decided in the scan, without a shuffle.

    Only texts go to the Python workers and only verdicts come back.
    """
    net = train(docs, labels, text_col=text_col)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(_scores(net, texts) >= 0.5, pa.bool_())

    return docs.where(good(F.col(text_col).cast("string")))
