"""Pairs of articles with roles in common: all of them, without a row for two articles that share one frequent role alone."""

import random
from itertools import combinations

import pytest

from newsloom.operators import lineage


@pytest.mark.parametrize("hot", [1, 4, 256])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_pairs_equal_all_pairs(spark, monkeypatch, hot, least):
    monkeypatch.setattr(lineage, "HOT", hot, raising=False)
    rng = random.Random(3)
    own = {i: {f"hot {k}" for k in rng.sample(range(6), rng.randint(0, 4))} | {f"rare {rng.randint(0, 60)}" for _ in range(rng.randint(0, 3))} for i in range(120)}
    own |= {200 + i: {"hot 1", "hot 2", "copy"} for i in range(9)} | {300 + i: set(own[i]) for i in range(20)} | {400: {"all alone"}}
    roles = spark.createDataFrame([(a, n) for a, ns in own.items() for n in ns], "article_id long, norm string")
    most = 60
    df = {}
    for ns in own.values():
        for n in ns:
            df[n] = df.get(n, 0) + 1
    use = {a: {n for n in ns if df[n] <= most} for a, ns in own.items()}
    want = {(a, b): len(use[a] & use[b]) for a, b in combinations(sorted(own), 2) if len(use[a] & use[b]) >= least}
    got = [tuple(r) for r in lineage.shared_pairs(roles, most * 5, least).collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_a_frequent_role_alone_makes_no_pairs(spark):
    n = 1200
    roles = spark.createDataFrame([(a, r) for a in range(n) for r in ("in all of them", f"own {a // 2}", f"other {a // 2} {a % 2}", f"third {a // 3}")], "article_id long, norm string")
    pairs = lineage.shared_pairs(roles, n * 5)
    want = {(a, b) for a, b in combinations(range(n), 2) if b - a < 3 and (a // 2 == b // 2 or a // 3 == b // 3)}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().executedPlan()
    seen = []

    def walk(node):
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            seen.append(node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        kids = node.children()
        for child in [*inner, *(kids.apply(i) for i in range(kids.size()))]:
            walk(child)

    walk(plan)
    assert seen and max(seen) > 0 and all(rows < n * 20 for rows in seen), seen
