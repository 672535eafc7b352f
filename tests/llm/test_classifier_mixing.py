"""Held-out accuracy of the classifier; marginals, calibration and edge cases of mixing."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import mixing, quality_classifier
from newsloom.storage import table

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    own = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(own) > 50 and np.mean([a == b for a, b in own]) > 0.95


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (3, "word " * 70_000, "z"), (3, "word", "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_classifier.classify(docs, none).collect()
    assert sorted((r.doc_id or -1) for r in rows) == [-1, 1, 3, 3] and {round(r.score, 6) for r in rows} == {0.5}
    assert quality_classifier.classify(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    bags = [np.abs(rng.normal(size=(n, quality_classifier.N_FEATURES))).astype(np.float32) for n in (1, 3, 2, 4)]
    y = np.array([0.0, 1, 1, 0])
    net = quality_classifier.GatedAttention(epochs=40).fit(bags, y)
    assert ((net.score(bags) > 0.5) == y.astype(bool)).all()


def test_marginals_hold_and_sampling_is_calibrated(spark):
    docs = table(spark, SMALL, "documents")
    target = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
    rows = mixing.mix(docs, target).toPandas()
    assert len(rows) == docs.count()
    total = rows.n_tokens.sum()
    share = (rows.weight * rows.n_tokens).groupby(rows.lang).sum() / total
    assert share.to_dict() == pytest.approx(target["lang"], abs=1e-6)
    base = rows.groupby("source").n_tokens.sum() ** mixing.TEMPERATURE
    share = (rows.weight * rows.n_tokens).groupby(rows.source).sum() / total
    assert share.to_dict() == pytest.approx((base / base.sum()).to_dict(), abs=1e-6)
    assert rows.probability.max() == pytest.approx(1) and (rows.probability >= 0).all()
    drawn = rows[rows.sampled]
    want = (rows.probability * rows.n_tokens).groupby(rows.lang).sum()
    got = drawn.n_tokens.groupby(drawn.lang).sum()
    assert np.allclose(got / got.sum(), want / want.sum(), atol=0.08)


def _brute(cells, goals):
    w = {k: float(v) for k, v in cells.items()}
    total = sum(w.values())
    for _ in range(200):
        for at, goal in enumerate(goals):
            for value, share in goal.items():
                own = sum(x for k, x in w.items() if k[at] == value)
                for k in w:
                    if k[at] == value and own:
                        w[k] *= share * total / own
    return w


def test_rake_equals_plain_loop(spark):
    cells = {(a, b, c): 3 + (7 * i + 5 * j + 11 * k) % 13 for i, a in enumerate("abc") for j, b in enumerate("xy") for k, c in enumerate("tu")}
    goals = [{"a": 0.5, "b": 0.25, "c": 0.25}, {"x": 0.4, "y": 0.6}, {"t": 0.6, "u": 0.4}]
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    got = {tuple(r[:3]): r.weight for r in mixing.rake(df, dict(zip(mixing.DIMS, goals, strict=True))).collect()}
    assert got == pytest.approx(_brute(cells, goals), rel=1e-5)


def test_mixing_edges(spark):
    schema = "doc_id long, text string, lang string, source string, weight string"
    docs = spark.createDataFrame([(1, None, None, None, "w"), (None, "", "en", "s", "w"), (2, "a b", "en", "s", "w"), (2, "a b", "en", "s", "w")], schema)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 4 and len({r.sampled for r in rows if r.doc_id == 2}) == 1
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.draw(docs).columns == docs.columns
    assert mixing.draw(docs.withColumn("topic", F.lit("t"))).count() <= 4


def test_one_odd_row_does_not_set_the_scale(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(-1, "three odd words", None, None), (-2, "one", "xx", "odd")], docs.schema)
    for target in (None, {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2, "xx": 1e-5}}):
        plain, more = mixing.mix(docs, target).toPandas(), mixing.mix(docs.unionByName(odd), target).toPandas()
        assert more.probability.mean() == pytest.approx(plain.probability.mean(), abs=0.01)
        for rows in (plain, more):
            want, got = (rows.n_tokens * rows.weight), (rows.n_tokens * rows.probability)
            scale = (rows.probability / rows.weight).max()
            assert (got <= scale * want * (1 + 1e-9)).all()
            assert 1 - got.sum() / (scale * want).sum() == pytest.approx(mixing.SHORT, abs=1e-4)
    assert mixing.mix(docs.unionByName(odd)).agg(F.avg("probability")).first()[0] > 0.8


def test_repeated_ids_do_not_push_others_out_of_training(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier.GatedAttention, "fit", lambda self, bags, y: seen.append((len(bags), y.tolist())) or self)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:8]
    docs = spark.createDataFrame([(i, f"text {k} of {i}") for n, i in enumerate(ids) for k in range(20 if n < 2 else 1)], "doc_id long, text string")
    quality_classifier.train(docs, spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int"), max_docs=8)
    assert seen == [(8, [0.0, 1.0] * 4)]
