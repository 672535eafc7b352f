"""The index that changes: equal to one built anew, and to plain search over what it should hold."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from newsloom.operators import search
from newsloom.operators.inverted import Index, hydrate
from newsloom.storage import children, fresh_path

WORDS = "alpha beta gamma delta news news-desk état naïve Ünder o'clock x y z rare one two three".split()
SCHEMA = "article_id long, title string, text string, author string, published string"


def articles(n, seed, first=0):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    return [(first + i, text(3), text(rng.randint(0, 30)), rng.choice([None, "ann", "bob smith"]), f"2024-01-{rng.randint(1, 28):02d}") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def postings(index):
    return sorted(map(tuple, index.postings().collect()), key=str)


def built(spark, rows, **options):
    index = Index.create(spark, fresh_path(spark, "built"), ("title", "text", "author"), buckets=8, blocks=16, **options)
    index.upsert(frame(spark, rows))
    return index


@pytest.fixture(scope="module")
def changed(spark):
    index = Index.create(spark, fresh_path(spark, "index"), ("title", "text", "author"), buckets=8, blocks=16)
    assert index.search("alpha").count() == 0 and index.documents().count() == 0
    now = {}
    for n, (count, seed, first) in enumerate([(60, 1, 0), (25, 2, 40), (10, 3, 5)]):
        batch = articles(count, seed, first)
        index.upsert(frame(spark, batch))
        now |= {r[0]: r for r in batch}
        gone = [3 + n, 50 + n, 999]
        index.delete(spark.createDataFrame([(g,) for g in gone], "article_id long"))
        now = {k: r for k, r in now.items() if k not in gone}
    return index, list(now.values())


QUERIES = ("alpha", "rare news", "news-desk", "beta gamma o'clock", "ETAT naive", "nothing", "smith", "", "!!")


def test_changes_equal_an_index_built_anew(spark, changed):
    index, rows = changed
    anew = built(spark, rows)
    assert postings(index) == postings(anew)
    assert {k: index.state[k] for k in ("articles", "words")} == {k: anew.state[k] for k in ("articles", "words")}
    for q in QUERIES[:2]:
        assert index.search(q, 15).collect() == anew.search(q, 15).collect()


def test_results_equal_plain_search(spark, changed):
    index, rows = changed
    old, docs = search.stored(frame(spark, rows), ("title", "text", "author"))
    for q in QUERIES:
        want = search.scores(old, docs.select("article_id", "length"), q).orderBy("score", "article_id").limit(15) if q.strip() else None
        got = [(r.article_id, r.score) for r in index.search(q, 15).collect()]
        assert got == ([tuple(r) for r in want.collect()] if want is not None else [])


def test_columns_asked_apart_equal_sqlite(spark, changed):
    index, rows = changed
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, text, author)")
    db.executemany("INSERT INTO f (rowid, title, text, author) VALUES (?, ?, ?, ?)", [(r[0], r[1], r[2], r[3] or "") for r in rows])
    for column, word in (("title", "alpha"), ("text", "rare"), ("author", "smith"), ("title", "smith")):
        want = {i for (i,) in db.execute("SELECT rowid FROM f WHERE f MATCH ?", (f"{column}: {word}",))}
        assert {r.article_id for r in index.search(word, 1000, (column,)).collect()} == want
    want = [(i, round(s, 6)) for i, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH 'alpha OR rare' ORDER BY round(bm25(f), 6), rowid LIMIT 20")]
    assert [(r.article_id, pytest.approx(r.score, abs=2e-6)) for r in index.search("alpha rare", 20).collect()] == want


def test_only_the_buckets_of_the_query_are_read(spark, changed):
    index, _ = changed
    rows = index._postings(["alpha"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters" in plan and "EqualTo(term,alpha)" in plan
    assert {r.bucket for r in rows.select("bucket").distinct().collect()} == {r.bucket for r in index._postings().where("term = 'alpha'").select("bucket").distinct().collect()}


def test_blocks_that_cannot_reach_the_last_place_are_not_scored(spark):
    rows = [(i, "t", "common " * (1 + i % 3) + "filler " * 40 + ("gem " * 6 if i % 100 == 7 else ""), None, "2024-01-01") for i in range(2000)]
    index = Index.create(spark, fresh_path(spark, "large"), ("title", "text"), buckets=8, blocks=256)
    index.upsert(frame(spark, rows))
    got = [(r.article_id, r.score) for r in index.search("common gem", 5).collect()]
    assert index.scored[0] < index.scored[1] / 4, index.scored
    old, docs = search.stored(frame(spark, rows), ("title", "text"))
    assert got == [tuple(r) for r in search.scores(old, docs.select("article_id", "length"), "common gem").orderBy("score", "article_id").limit(5).collect()]


def test_merge_reopen_and_vacuum(spark, changed):
    index, rows = changed
    other = Index(spark, index.path)
    before, best = postings(index), index.search("alpha rare", 10).collect()
    other.merge()
    assert len(other.state["segments"]) == 1 and postings(other) == before and other.search("alpha rare", 10).collect() == best
    assert postings(index) == before  # a reader of before sees what it saw
    assert other.vacuum() > 0 and len([p for p in children(spark, index.path) if "/s-" in p]) == 1
    again = Index(spark, index.path)
    assert postings(again) == before and again.search("alpha rare", 10).collect() == best
    with pytest.raises(FileExistsError):
        Index.create(spark, index.path)
    with pytest.raises(FileNotFoundError):
        Index(spark, index.path + "-none")


def test_limits_stems_repeats_and_hits(spark):
    rows = [(1, "Running", "late " * 700 + "word", None, "2024-01-01"), (1, "runs", "newest", None, "2024-01-02"), (2, None, None, None, None), (3, "the runner", "late " * 700 + "word", None, "2024-01-03")]
    index = Index.create(spark, fresh_path(spark, "stems"), ("title", "text"), buckets=4, blocks=4, text_limit=3000, stemmed=True)
    index.upsert(frame(spark, rows))
    assert [r.article_id for r in index.search("running").collect()] == [1] and index.search("word").count() == 0
    assert index.documents().count() == 3
    hits = hydrate(index.search("late newest", 5), frame(spark, rows[1:]).drop("published").where("article_id <> 3"))
    assert [(r.article_id, r.title) for r in hits.collect()] == [(1, "runs")]
    index.delete(spark.createDataFrame([(1,), (2,), (3,)], "article_id long"))
    assert index.search("late").count() == 0 and index.state["articles"] == 0
    index.merge()
    assert index.documents().count() == 0 and index.search("late").count() == 0


def test_folding_equals_sqlite(spark):
    marked = [c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c.isalpha()]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    db.executemany("INSERT INTO f (rowid, t) VALUES (?, ?)", [(ord(c), f"q{c}q") for c in marked])
    want = {doc: term for term, doc in db.execute("SELECT term, doc FROM v")}
    got = {r.i: r.t for r in spark.createDataFrame([(ord(c), f"q{c}q") for c in marked], "i long, t string").select("i", search.fold(F.col("t")).alias("t")).collect()}
    wrong = {chr(i) for i in got if got[i] != want.get(i)}
    assert len(wrong) < 40, sorted(wrong)
    assert not wrong & set("āčďéěğīķļłñňóőřšşťūůűýźžĀČŠŽ")


def test_an_upsert_moves_texts_once_and_no_word(spark, monkeypatch):
    """Postings are made where the text is: texts in words are not written, and a plan of them has the one shuffle of texts."""
    plans = []
    write = Index._write

    def seen(self, segment, postings, *more):
        plans.append(postings._jdf.queryExecution().executedPlan().toString())
        write(self, segment, postings, *more)

    def no(*_, **__):
        raise AssertionError("texts are written once more")

    monkeypatch.setattr(Index, "_write", seen)
    monkeypatch.setattr("newsloom.storage.materialize", no)
    rows = [(1, "a b a", "b c b b", None, "2024-01-01"), (2, None, "", None, "2024-01-02"), (3, "c", None, "a", None)]
    index = built(spark, rows)
    assert plans[0].count("Exchange") == 1, plans[0]
    got = {(r.term, r.article_id, r.col): (list(r.at), r.length, r.published) for r in index.postings().collect()}
    assert got == {("a", 1, 0): ([0, 2], 7, "2024-01-01"), ("b", 1, 0): ([1], 7, "2024-01-01"), ("b", 1, 1): ([0, 2, 3], 7, "2024-01-01"), ("c", 1, 1): ([1], 7, "2024-01-01"),
                   ("c", 3, 0): ([0], 2, None), ("a", 3, 2): ([0], 2, None)}
    assert sorted(map(tuple, index.documents().collect())) == [(1, "2024-01-01", 7), (2, "2024-01-02", 0), (3, None, 2)]
    heads = {r.term: r.n for r in index._table("heads").groupBy("term").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert heads == {"a": 2, "b": 1, "c": 2}
