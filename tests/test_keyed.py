"""Tables in buckets: changes touch their own buckets and may be repeated."""

import glob

import pytest
from pyspark.sql import functions as F

from newsloom import storage
from newsloom.keyed import KeyedTable, role_dimension, role_references
from newsloom.storage import fresh_path

SCHEMA = "id long, v string, at int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_rewrite_their_own_buckets(spark):
    path = fresh_path(spark, "keyed")
    store = KeyedTable(spark, path, ("id",), 32)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.delete(spark.createDataFrame([(1,)], "id long"))
    store.upsert(spark.createDataFrame([(i, "a", 0) for i in range(500)], SCHEMA), "at")
    files = lambda: {*glob.glob(path.removeprefix("file://") + "/_bucket=*/*.parquet")}
    before = files()
    change = spark.createDataFrame([(7, "late", 3), (7, "later", 9), (7, "last", 5), (900, "new", 1), (None, "x", 1)], SCHEMA)
    store.upsert(change, "at")
    assert len(before - files()) <= 2 and len(files() - before) <= 2
    want = [(i, "later", 9) if i == 7 else (i, "a", 0) for i in range(500)] + [(900, "new", 1)]
    assert rows(store.read()) == sorted(want, key=str)
    store.upsert(change, "at")
    assert rows(store.read()) == sorted(want, key=str)
    store.delete(spark.range(100, 2000))
    assert rows(store.read()) == sorted(want[:100], key=str)
    plan = store.read().where("id = 7")
    assert plan.count() == 1
    store.delete(spark.range(0, 2000))
    with pytest.raises(FileNotFoundError):
        store.read()


def test_ties_are_settled_by_contents(spark):
    tied = [(1, c, 0) for c in "abcdefgh"]
    got = set()
    for turn in (tied, tied[::-1], tied[3:] + tied[:3]):
        store = KeyedTable(spark, fresh_path(spark, "ties"), ("id",), 4)
        store.upsert(spark.createDataFrame(turn, SCHEMA).repartition(3), "at")
        got.add(rows(store.read())[0])
    assert len(got) == 1


def test_role_counts_after_two_batches_equal_one(spark):
    all_of = spark.createDataFrame([(f"r{i % 7}", i % 30, f"norm {i % 7}") for i in range(200)], "role_id string, article_id long, norm string").distinct()
    store = role_references(spark, fresh_path(spark, "refs"), 8)
    for part in ("article_id < 12", "article_id >= 10", "article_id < 5"):
        store.upsert(all_of.where(part), "article_id")
    assert rows(role_dimension(store.read())) == rows(role_dimension(all_of))
    assert role_dimension(all_of).agg(F.sum("reference_count")).first()[0] == all_of.count()


def test_an_upsert_writes_its_buckets_once(spark, monkeypatch):
    tags, write = [], storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df, tag, free=True: tags.append(tag) or write(df, tag, free))
    store = KeyedTable(spark, fresh_path(spark, "once"), ("id",), 4)
    for first in (0, 20, 10):
        store.upsert(spark.createDataFrame([(i, f"from {first}", first) for i in range(first, first + 30)], SCHEMA), "at")
    assert rows(store.read()) == sorted([(i, f"from {10 if 10 <= i < 40 else 20 if i >= 40 else 0}", 10 if 10 <= i < 40 else 20 if i >= 40 else 0) for i in range(50)], key=str)
    assert "buckets" not in tags
