"""Exact and SimHash deduplication against brute force, and their edge cases."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import exact_dedup, simhash
from newsloom.storage import children, fresh_path, table

SMALL = "/root/testdata/sf0.01"


def _fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _plain_exact(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[_fold(text)].append(i)
    return sorted((i, max(groups[_fold(t)]), len(groups[_fold(t)]), i == max(groups[_fold(t)]), hashlib.sha256(_fold(t).encode()).hexdigest()) for i, t in rows)


def test_exact_equals_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    want = _plain_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, exact_dedup.deduplicate(docs).collect())) == want


def test_exact_edges_and_hot_group(spark):
    rows = [(i, "Same TEXT É") for i in range(1500)] + [(2000 + i, f"t{i // 2}") for i in range(2000)] + [(9001, None), (9002, ""), (9003, "SAME text É"), (9004, "same text é"), (9005, "ſ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit("clash"))
    assert sorted(map(tuple, exact_dedup.deduplicate(docs).collect())) == _plain_exact(rows)
    assert exact_dedup.drop_copies(docs).count() == len({_fold(t) for _, t in rows})
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a"), (None, "b"), (1, "A"), (1, "A")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(null).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)], key=str)


def test_index_persists_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "B"), (5, "c"), (6, "c")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.deduplicate(first, index=index).collect() if r.kept} == {2, 3}
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(second, index=index).collect()}
    assert got == {4: (2, False), 5: (6, False), 6: (6, True)} and index.read().count() == 3


def test_index_outlives_its_session(spark, sf):
    """The second session knows the folder alone; both batches together give the answer of all rows at once."""
    docs = table(spark, sf, "documents")
    path, name = fresh_path(spark, "index"), "newsloom_kept"
    want = sorted(map(tuple, exact_dedup.deduplicate(docs).where("kept").collect()))
    late, early = docs.where("doc_id >= 120"), docs.where("doc_id < 120")
    first = exact_dedup.DigestIndex(spark, name, path, buckets=3)
    kept = exact_dedup.deduplicate(late, index=first).where("kept").select("doc_id", "text_sha256").collect()
    files = sorted(children(spark, path))
    spark.sql(f"DROP TABLE {name}")  # what ends with a session: its catalogue
    second = exact_dedup.DigestIndex(spark, name, path, buckets=7)
    assert second.buckets == 3 and sorted(children(spark, path)) == files and second.read().count() == len(kept)
    joined = second.unseen(exact_dedup.group_digests(exact_dedup.digests(early)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joined and "Bucketed: true" in joined
    kept += exact_dedup.deduplicate(early, index=second).where("kept").select("doc_id", "text_sha256").collect()
    assert sorted((r.doc_id, r.text_sha256) for r in kept) == [(w[0], w[4]) for w in want]
    assert not any(r.kept for r in exact_dedup.deduplicate(docs, index=second).collect())
    third = exact_dedup.DigestIndex(spark, "newsloom_other_name", path)
    assert third.read().count() == second.read().count()
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, name, fresh_path(spark, "elsewhere"))
    second.drop()


def test_batches_fall_by_id(spark):
    rows = spark.createDataFrame([(i,) for i in (5, None, -3, 9, 9, 0, 1)], "doc_id long")
    for parts in (1, 2, 3, 50):
        got = [[r.doc_id for r in p.collect()] for p in exact_dedup.falling(rows, parts)]
        flat = [min(x, key=lambda v: -99 if v is None else v) for x in got if x]
        assert sorted(sum(got, []), key=str) == sorted([5, None, -3, 9, 9, 0, 1], key=str)
        assert flat == sorted(flat, key=lambda v: 99 if v is None else -v)
    assert len(exact_dedup.falling(rows.limit(0), 2)) == 1


def test_append_is_an_anti_join_and_may_be_repeated(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    plan = index.unseen(exact_dedup.group_digests(exact_dedup.digests(docs)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") == 1  # the index is not shuffled
    once = sorted(map(tuple, exact_dedup.deduplicate(docs, index=index, batch="b1").collect()))
    assert sorted(map(tuple, exact_dedup.deduplicate(docs, index=index, batch="b1").collect())) == once and index.read().count() == 2
    half = exact_dedup.DigestIndex(spark, buckets=3)  # a first try that ended in the middle
    half.append(exact_dedup.group_digests(exact_dedup.digests(docs)).where("group_size = 2"), "b1")
    assert sorted(map(tuple, exact_dedup.deduplicate(docs, index=half, batch="b1").collect())) == once
    assert not any(r.kept for r in exact_dedup.deduplicate(docs, index=index, batch="b2").collect())
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.deduplicate(docs).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def _plain_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([fps[i] for i in ids], np.uint64)
    for at, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[at + 1 :] ^ values[at]) <= 3):
            a, b = sorted((find(i), find(ids[at + 1 + j])))
            root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    fps = {r.doc_id: _plain_fp(r.text) for r in docs.collect()}
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == _plain_components(fps) and len(got) == len(fps)


def test_links_lose_nothing_in_dense_families(spark):
    rng = np.random.default_rng(5)
    fps = {0}
    for centre in rng.integers(0, 1 << 63, 3, dtype=np.uint64):
        for _ in range(700):  # far more than a block, all near each other
            fps.add(int(centre) ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 5), replace=False)))
    for _ in range(1500):
        a = int(rng.integers(0, 1 << 63, dtype=np.uint64))
        fps |= {a, a ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))}
    fps = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps.values()], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df).collect()]
    assert len(edges) < 40 * len(fps)
    root = {x: x for x in fps.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = _plain_components(fps)
    assert {i: find(x) for i, x in fps.items()} == {i: fps[r] for i, r in want.items()}


def test_simhash_edges(spark):
    rows = [(5, None), (3, ""), (4, " \n\t"), (7, "One two"), (8, "one TWO"), (None, "one two"), (9, "a b c " * 20_000), (9, "a b c " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (4, 3), (7, 7), (8, 7), (None, 7), (9, 9), (9, 9)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.drop_near_copies(docs).columns == docs.columns


def test_one_row_of_each_text_where_ids_repeat(spark):
    x, y = "one text of some words that is given more than once", "quite another story, told with other words and longer than that"
    for rows, last, first in (
        ([(1, x), (5, x), (1, y)], [(1, y), (5, x)], [(1, x), (1, y)]),
        ([(1, x), (1, x), (1, x.upper())], 1, 1),
        ([(0, y), (1, x), (1, y), (1, x), (None, x)], [(1, x), (1, y)], [(0, y), (1, x)]),
        ([(None, x), (None, x), (2, y)], 2, 2),
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit("m"))
        for drop, want in ((exact_dedup.drop_copies, last), (simhash.drop_near_copies, first or last)):
            got = drop(docs)
            assert got.columns == docs.columns
            if isinstance(want, int):
                assert got.count() == want
                continue
            assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(want)
