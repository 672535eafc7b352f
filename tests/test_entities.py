"""Entities of narratives, and texts to look for, against plain loops; only what can be asked for is moved."""

import random

from newsloom.operators import intersection, lineage
from newsloom.plans import engine


def rows(spark):
    rng = random.Random(3)
    held = {(a, f"role {rng.randint(0, 60)}") for a in range(30) for _ in range(40)} | {(99, "role x"), (5, "ab")}
    role = spark.createDataFrame([(a, n, f"id of {n}") for a, n in sorted(held)], "article_id long, norm string, role_id string")
    member = spark.createDataFrame([(a, a % 4) for a in range(31)], "article_id long, cluster_id long")
    return held, role, member


def test_the_first_of_a_narrative_are_among_the_first_of_its_articles(spark):
    held, role, member = rows(spark)
    want = {(c, n) for c in range(4) for n in sorted({n for a, n in held if a < 30 and a % 4 == c and len(n) >= 3})[:12]}
    out = lineage.entities(member, role)
    assert set(map(tuple, out.collect())) == want and out.count() == len(want)
    plan = lineage.entities(member, role)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit [article_id") == 2  # before the shuffle, and after it


def test_the_most_frequent_role_and_fits(spark):
    held, role, _ = rows(spark)
    n = {}
    for a, norm in held:
        n.setdefault(norm, []).append(a)
    top = min(n, key=lambda x: (-len(n[x]), x))
    other = max(x for x in n if min(n[top]) in n[x] and x != top)
    assert engine._texts(role) == [top, " ".join(other.split(" ")[:3])]
    # Roles are matched where they are read: nothing is shuffled before.
    out = intersection.match_roles(role, ["role 7", "nothing like it at all"])
    assert {(r.spec, r.norm) for r in out.collect()} >= {(0, "role 7")} and out.count() == out.distinct().count()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Aggregate") < plan.index("Generate")
