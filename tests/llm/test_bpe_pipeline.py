"""Exact ids against the tokenizers library; the classifier and the sampler against plain loops; the pipeline as a whole."""

import hashlib
import importlib
import math
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from newsloom.llm import bpe, exact_dedup, mixing, quality_classifier, queries, simhash
from newsloom.storage import table

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def _library(texts):
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        yield len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def _equal(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, PATH).collect()), key=str)
    assert got == sorted([(i, *x) for (i, _), x in zip(rows, _library([t for _, t in rows]), strict=True)], key=str)


def test_ids_equal_the_library(spark):
    _equal(spark, [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()])


def test_odd_texts_equal_the_library(spark):
    rnd = random.Random(11)
    special = list(Tokenizer.from_file(PATH).get_added_tokens_decoder().values())
    pieces = ["the", "Straße", "ΣΑΣ", "e\u0301", "\u00a0", "\u2003", "\x1c", "\x85", "\u200b", "\U0001f600\u200d\U0001f4bb", "12,345.6", "don't", "_", "<|", "|>", "İ", "ﬁ", "漢字", "\n\n", "\t", "a-b", "\x00", *[t.content for t in special]]
    rows = [(i, "".join(rnd.choice([" ", "", "\n"]) + rnd.choice(pieces) for _ in range(rnd.randrange(60)))) for i in range(1500)]
    rows += [(9001, None), (9002, ""), (9003, " \n"), (None, "null id"), (9004, "long " * 60_000), (9005, "x" * 20_000), (9006, "same"), (9006, "same")]
    _equal(spark, rows)
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ids_decode_to_the_same_words(spark):
    docs = spark.createDataFrame([(1, "plain words of a sentence, twice.")], "doc_id long, text string")
    row = bpe.encode(docs, PATH, with_ids=True).first()
    tok = Tokenizer.from_file(PATH)
    assert tok.decode(np.frombuffer(row.ids, "<u4").tolist(), skip_special_tokens=False) == row.decoded


def _plain_score(p, bag):
    """Gated attention over one bag, number by number."""
    codes, marks = [], []
    for x in bag.tolist():
        h = [math.tanh(sum(x[i] * p["E"][i][j] for i in range(len(x)))) for j in range(p["E"].shape[1])]
        t = [math.tanh(sum(h[i] * p["V"][i][j] for i in range(len(h)))) for j in range(p["V"].shape[1])]
        g = [1 / (1 + math.exp(-sum(h[i] * p["U"][i][j] for i in range(len(h))))) for j in range(p["U"].shape[1])]
        codes.append(h)
        marks.append(sum(a * b * w for a, b, w in zip(t, g, p["w"], strict=True)))
    top = sum(math.exp(m) for m in marks)
    z = [sum(math.exp(m) / top * h[j] for m, h in zip(marks, codes, strict=True)) for j in range(len(codes[0]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["b"][0])))


def test_scores_equal_a_plain_loop(spark):
    docs, labels = table(spark, SMALL, "documents").where("doc_id < 60"), table(spark, SMALL, "labels")
    net = quality_classifier.train(docs, labels)
    want = {r.doc_id: _plain_score(net.weights, quality_classifier.passages(r.text).astype(float)) for r in docs.collect()}
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels, model=net).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_gradients_equal_differences(monkeypatch):
    """One step of Adam moves each weight against its gradient's sign, which differences of the loss give."""
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, quality_classifier.N_FEATURES)) for n in (2, 1, 4)]
    y = np.array([1.0, 0, 1])
    start = quality_classifier.GatedAttention(epochs=3, decay=0.0, rate=0.05).fit(bags, y)
    net = quality_classifier.GatedAttention(epochs=3, decay=0.0)
    net.weights = {k: w.copy() for k, w in start.weights.items()}
    loss = lambda: -np.mean(y * np.log(net.score(bags)) + (1 - y) * np.log(1 - net.score(bags)))
    before, one = loss(), quality_classifier.GatedAttention(epochs=4, decay=0.0, rate=0.05).fit(bags, y)
    moved = {k: one.weights[k] - start.weights[k] for k in start.weights}
    slope = 0.0
    for k, w in net.weights.items():
        for at in np.ndindex(w.shape):
            w[at] += 1e-6
            slope += (loss() - before) / 1e-6 * moved[k][at]
            w[at] -= 1e-6
    assert slope < 0  # the fourth step goes down


def test_draw_equals_the_sampled_rows_and_keeps_clashing_columns(spark):
    docs = table(spark, SMALL, "documents").withColumns({"_mix_p": F.lit(0.0), "_mix__p": F.lit(1), "_cell_p": F.lit(2), "_own_source": F.lit("x"), "probability": F.lit("y")})
    drawn = mixing.draw(docs)
    want = {r.doc_id for r in mixing.mix(docs).collect() if r.sampled}
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == want and 0 < len(want) < docs.count()


def test_pipeline_equals_its_stages_by_plain_loops(spark, monkeypatch):
    """Each stage is held against a plain rule on what the stage before it kept."""
    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    written, write = {}, corpus_pipeline.materialize

    def recorded(df, name):
        written[name] = write(df, name)
        return written[name]

    monkeypatch.setattr(corpus_pipeline, "materialize", recorded)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert list(written) == names[:-1] and all(df.columns == docs.columns for df in written.values())
    kept = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in written.items()}
    net = quality_classifier.train(docs, table(spark, SMALL, "labels"))
    assert kept["quality_classifier"] == {i for i, t in texts.items() if net.score([quality_classifier.passages(t)])[0] >= 0.5}
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    last = {}
    for i in sorted(kept["quality_classifier"]):
        last[fold(texts[i])] = i
    assert kept["exact_dedup"] == set(last.values())
    ids = sorted(kept["exact_dedup"])
    marks = [simhash.fingerprint(texts[i]) & (1 << 64) - 1 for i in ids]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in enumerate(marks):
        for b in range(a + 1, len(ids)):
            if (x ^ marks[b]).bit_count() <= 3:
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    assert kept["simhash_near_dedup"] == {find(i) for i in ids}
    near = docs.where(F.col("doc_id").isin(*kept["simhash_near_dedup"]))
    assert kept["mixing"] == {r.doc_id for r in mixing.mix(near).collect() if r.sampled}
    assert got == dict(zip(sorted(kept["mixing"]), _library([texts[i] for i in sorted(kept["mixing"])]), strict=True))


def test_stages_bear_odd_tables(spark):
    rows = [(1, None, "en", "s", 0), (1, "a b c d", "en", "s", 7), (None, "a b c d", None, None, None), (2, "", "en", "s", 0), (3, "w " * 40_000, "fr", None, 1), (3, "w " * 40_000, "fr", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(1), "keep_id": F.lit(2), "fp": F.lit(3), "weight": F.lit(4)})
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, TINY)
        assert now.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, now, TINY).count() == now.count() <= docs.count()
    assert exact_dedup.drop_copies(docs).count() == 3


def test_entry_without_the_operators(monkeypatch):
    import __spark_entry__ as entry

    full = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= full
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("newsloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "newsloom.llm", None)
    monkeypatch.setitem(sys.modules, "newsloom.llm.queries", None)
    monkeypatch.delattr(importlib.import_module("newsloom"), "llm", raising=False)
    rest = set(entry.queries())
    assert rest == full - set(queries.QUERIES) - {"pipeline"} and set(entry.oracle_sql()) <= rest
