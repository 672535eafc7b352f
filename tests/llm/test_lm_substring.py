"""Language-model scores and substring removal against brute force, and their edge cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import chunks, ngram_lm, substring_dedup
from newsloom.storage import table

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def _tokens(text):
    return [*(text or "").encode().lower().split(), None]


def _plain_lm(rows):
    """The definition, pair by pair: counts, weights by the same expectation-maximisation without a grid, scores."""
    part = {i: ngram_lm.part_of(i) for i, _ in rows}

    def count(parts):
        pair, context, token = Counter(), Counter(), Counter()
        for i, text in rows:
            if part[i] in parts:
                ts = _tokens(text)
                token.update(ts)
                pair.update(zip(["<s>", *ts[:-1]], ts, strict=True))
        # A context's count is how often its token was seen, and of the start the number of texts.
        context.update(token)
        context["<s>"] = sum(part[i] in parts for i, _ in rows)
        return pair, context, token, sum(token.values()), len(token)

    pair, context, token, n, v = count({1})
    seen = {b: [] for b in range(ngram_lm.BUCKETS)}
    for i, text in rows:
        if part[i] == 2:
            ts = _tokens(text)
            for h, w in zip(["<s>", *ts[:-1]], ts, strict=True):
                c = context[h]
                b = min(c.bit_length(), ngram_lm.BUCKETS - 1)
                seen[b].append((pair[h, w] / c if c else 0, token[w] / n, 1 / (v + 1)))
    weights, last = [], np.array([0, 0.9, 0.1])
    for b in range(ngram_lm.BUCKETS):
        if seen[b]:
            like = np.array(seen[b])
            w = np.array([0.5, 0.4, 0.1]) if b else np.array([0, 0.9, 0.1])
            for _ in range(60):
                share = like * w
                w = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) + np.array([1e-3 * (b > 0), 1e-3, 1e-3])
                w /= w.sum()
            last = w
        weights.append(last if b else np.array([0, *(last[1:] / last[1:].sum())]))
    pair, context, token, n, v = count({1, 2})
    out = {}
    for i, text in rows:
        ts = _tokens(text)
        score = base = 0
        for h, w in zip(["<s>", *ts[:-1]], ts, strict=True):
            c = context[h]
            mix = weights[min(c.bit_length(), ngram_lm.BUCKETS - 1)]
            score += math.log10(mix[0] * (pair[h, w] / c if c else 0) + mix[1] * token[w] / n + mix[2] / (v + 1))
            base += math.log10((token[w] + 1) / (n + v + 1))
        out[i] = (part[i] == 0, len(ts), sum(token[w] > 0 for w in ts), n, base, score)
    return out


def test_lm_equals_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    want = _plain_lm([(r.doc_id, r.text) for r in docs.collect()])
    rows = ngram_lm.score(docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=2e-3)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_edges(spark):
    rows = [(1, None), (2, ""), (None, "a B"), (3, "b " * 50_000), (3, "b"), (8, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = ngram_lm.score(docs).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 3), (1, 1), (2, 1), (3, 2), (3, 50_001), (8, 2)]
    assert all(math.isfinite(r.score) for r in got)
    assert ngram_lm.score(docs.limit(0)).count() == 0
    only = docs.where("doc_id = 8")
    assert ngram_lm.score(only).count() == 1


def _plain_removed(rows):
    size, first = substring_dedup.SPAN, {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        if i is not None:
            for p in range(len(t) - size + 1):
                s = t[p : p + size]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        if i is not None:
            for p in range(len(t) - size + 1):
                if first[t[p : p + size]] < i:
                    gone[p : p + size] = b"\1" * size
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substrings_equal_brute_force(spark):
    docs = table(spark, TINY, "documents")
    want = _plain_removed([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()), key=str)
    assert got == want and sum(w[2] for w in want) > 1000


def test_substring_edges(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared, other = word(120), word(49)
    rows = [(5, word(30) + shared + word(40)), (2, shared), (9, "x" + shared[:50] + "y" + shared[30:90]), (4, other), (6, other), (7, "a" * 300), (8, "a" * 49 + "b" * 200), (10, "a" * 51)]
    rows += [(11, None), (12, ""), (None, shared), (13, shared * 3), (13, shared * 3), (14, "é" * 30), (15, "zé" + "é" * 24), (20, word(20) + "q" * 10 + shared[20:75])]
    rows += [(100 + i, word(12) + shared[10:] + word(9)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()), key=str)
    assert got == _plain_removed(rows)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    kept = {r.doc_id: r.kept for r in substring_dedup.remove_repeats(docs, with_text=True).collect()}
    assert kept[2] == shared.encode() and hashlib.sha256(kept[5]).hexdigest() == next(r[4] for r in got if r[0] == 5)


def test_substrings_whose_key_is_zero(spark):
    """The anchor in the middle of the shared 50 bytes hashes to a key of 0, the smallest there is."""
    anchor = b"ugaukcwfjtvwppyk"
    key = substring_dedup._Hashes(np.frombuffer(anchor, np.uint8), 0).all(16) >> np.uint64(32)
    assert key[0] == 0
    shared = "abcdefghijklmnopq" + anchor.decode() + "rstuvwxyzABCDEFGH"
    rows = [(1, "one: " + shared + " first"), (2, "two; " + shared + " second"), (3, anchor.decode() * 9), (4, "x" + anchor.decode() * 7)]
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(_plain_removed(rows))
    assert {r[0]: r[2] for r in got}[2] >= 50


def test_blocks_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    columns = {"a": np.arange(len(keys), dtype=np.int64), "b": (np.arange(len(keys)) % 7).astype(np.uint8)}
    back, got = chunks.unpack(chunks.pack(keys, columns))
    assert (back == keys).all() and all((got[k] == columns[k]).all() for k in columns)
    parts = list(chunks.ranges(keys, 9))
    assert sum(s.stop - s.start for _, s in parts) == len(keys)


def _unmixed(x):
    """The number that ``mix64`` makes ``x`` of."""
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        y = x
        for _ in range(3):
            y = x ^ (y >> shift)
        x = y * pow(factor, -1, 1 << 64) % (1 << 64)
    return x


def test_keys_that_differ_in_their_last_bit_stay_apart():
    keys = [0x123456789ABCDEF0, 0x123456789ABCDEF1]
    hashes = np.array([_unmixed(k) for k in keys], np.uint64)
    assert chunks.mix64(hashes).tolist() == keys
    assert len(np.unique(ngram_lm._token_key(hashes))) == 2
