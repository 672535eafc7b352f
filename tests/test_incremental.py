"""Narratives by batches against a rebuild over all articles."""

import random

import pytest

from newsloom.operators import incremental, lineage
from newsloom.operators.graph import connected_components
from newsloom.storage import children, fresh_path

SCHEMA = "article_id long, text string, source_id string, event_ts string, event_sec long, title string"


def article(i, roles, sec=None):
    text = ". ".join(f"the sentence number {r} of all" for r in roles)
    return (i, text, f"src{i % 4}", None if sec is None else f"2024-01-01 00:00:{sec % 60:02d}", sec, f"t{i}")


def rebuilt(spark, rows):
    """(article, narrative) by the lineage over everything."""
    arts = spark.createDataFrame(rows, SCHEMA)
    own = lineage.roles(arts.select("article_id", "text")).select("article_id", "norm")
    label = {r.node: r.component for r in connected_components(lineage.linked(own, len(rows)), small=10_000).collect()}
    return {r[0]: label.get(r[0], r[0]) for r in rows}


def by_batches(spark, batches):
    state, seen = incremental.Narratives(spark, fresh_path(spark, "narratives")), []
    for batch in batches:
        before = {r.article_id: r.cluster_id for r in state.labels().collect()}
        moved = {r.article_id: (r.was, r.cluster_id) for r in state.add(spark.createDataFrame(batch, SCHEMA)).collect()}
        seen += batch
        after = {r.article_id: r.cluster_id for r in state.labels().collect()}
        assert after == rebuilt(spark, seen)
        assert moved == {i: (before.get(i), c) for i, c in after.items() if before.get(i) != c}
    return state


def test_roles_that_begin_and_cease_to_count(spark):
    # Two roles link 1 to 6; with eight more holders one of them is too frequent, and with many others it counts again.
    first = [article(i, ["p", "q"]) for i in (5, 6, 4)]
    second = [article(i, ["p", "q"]) for i in (1, 2)]
    third = [article(i, ["p", f"own{i}"]) for i in range(10, 18)]
    fourth = [article(i, [f"lone{i}", f"other{i}"]) for i in range(100, 170)]
    state = by_batches(spark, [first, second, third, fourth])
    assert {r.cluster_id for r in state.labels().where("article_id <= 6").collect()} == {1}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_equals_the_rebuild(spark, seed):
    rng = random.Random(seed)
    rows = [article(i, rng.sample(range(30), rng.randint(0, 3)), rng.choice([None, rng.randint(0, 10**6)])) for i in range(70)]
    rows += [article(200 + i, ["hot", "hotter", "x"]) for i in range(20)]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    by_batches(spark, [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]])


def test_late_articles_repeats_and_a_restart(spark):
    path = fresh_path(spark, "narratives")
    add = lambda rows: incremental.Narratives(spark, path).add(spark.createDataFrame(rows, SCHEMA)).count()
    assert add([article(7, ["a", "b"], 50), article(8, ["a", "b"], 60)]) == 2
    assert add([article(9, ["a", "b"], 10)]) == 1
    state = incremental.Narratives(spark, path)
    assert [(r.article_id, r.rn, r.cluster_id) for r in state.members().orderBy("rn").collect()] == [(9, 1, 7), (7, 2, 7), (8, 3, 7)]
    assert add([article(9, ["other", "roles"], 1), article(9, ["more", "roles"], 1)]) == 0
    assert add([article(3, ["a", "b"], None), (None, "x", None, None, None, None)]) == 4  # the smallest id names it
    state = incremental.Narratives(spark, path)
    want = sorted(map(tuple, state.members().collect()))
    state.compact()
    assert state.vacuum() == 4 and len([p for p in children(spark, path) if "/b-" in p]) == 1
    assert sorted(map(tuple, incremental.Narratives(spark, path).members().collect())) == want
    plan = state.members()._jdf.queryExecution().toString()
    assert "text" not in plan.split("== Physical Plan ==")[1].replace("text file", "")


def test_a_stream_of_files(spark):
    source, path, checkpoint = (fresh_path(spark, n) for n in ("drop", "narratives", "at"))
    drops = [[article(1, ["a", "b"], 5), article(2, ["c", "d"], 6)], [article(3, ["a", "b", "c", "d"], 1)]]
    for rows in drops:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").json(source)
        incremental.follow(spark.readStream.schema(SCHEMA).json(source), path, checkpoint).awaitTermination()
    assert {r.article_id: r.cluster_id for r in incremental.Narratives(spark, path).labels().collect()} == rebuilt(spark, sum(drops, [])) == {1: 1, 2: 1, 3: 1}
    assert incremental.Narratives(spark, fresh_path(spark, "none")).members().count() == 0


def test_families_of_edited_copies_make_no_pairs(spark, monkeypatch):
    # Of one text many copies, each without another sentence: every two of them share roles, but few links are enough.
    family = [article(i, [r for r in range(12) if r != i % 12] + [f"own{i}"]) for i in range(1, 61)]
    others = [article(100 + i, [f"lone{i}", f"more{i}"]) for i in range(300)]
    made, links = [], incremental.Narratives._links

    def counted(self, rows, asked):
        out = links(self, rows, asked)
        made.append(out.count())
        return out

    monkeypatch.setattr(incremental.Narratives, "_links", counted)
    by_batches(spark, [family[::2] + others[::2], family[1::2] + others[1::2]])
    assert sum(made) < 10 * len(family) < 60 * 59 // 2
