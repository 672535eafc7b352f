"""Links of overlapping sets against all pairs, and how many rows they make."""

import itertools
import random

import pytest

from newsloom.operators import overlap
from newsloom.operators.graph import connected_components


def parts(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {x: min(y for y in up if root(y) == root(x)) for x in up}


def all_pairs(sets):
    return [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 2]


def table(spark, sets):
    return spark.createDataFrame([(a, k) for a, keys in sets.items() for k in sorted(keys)], "article_id long, key string")


def cases():
    rng = random.Random(5)
    zipf = {i: {f"k{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(0, 9))} for i in range(150)}
    # One role in every set, a second one in chains of two, a third that only pairs with rare ones.
    hot = {i: {"all", f"c{i // 2}", f"d{(i + 1) // 2}"} | ({"half"} if i % 7 == 0 else set()) for i in range(120)}
    frequent_only = {i: {f"h{j}" for j in range(6) if (i >> j) & 1} for i in range(64)}
    return {"zipf": zipf, "hot": hot, "frequent": frequent_only, "one": {1: {"a", "b"}, 2: {"b", "c"}, 3: {"a", "c"}}, "empty": {}}


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("bound", [None, 1, 4, 1 << 20])
def test_components_equal_those_of_all_pairs(spark, name, bound):
    sets = cases()[name]
    got = [(r.a, r.b) for r in overlap.links(table(spark, sets), bound=bound).collect()]
    assert all(a < b and len(sets[a] & sets[b]) >= 2 for a, b in got)
    assert parts(got) == parts(all_pairs(sets))


def test_a_role_in_many_unequal_sets_makes_no_square(spark):
    n = 3000
    sets = {i: {"shared", f"own{i // 2}", f"x{i}"} for i in range(n)}  # all have one role, each two have a second
    rows = overlap.counted(table(spark, sets), "article_id", "key")
    known = overlap.costs(rows)
    best = min(known, key=known.get)
    assert known[best] < 10 * n < known[1 << overlap.POWERS]
    found = overlap.links(table(spark, sets))
    assert found.count() == n // 2
    label = {r.node: r.component for r in connected_components(found).collect()}
    assert label == {i: i // 2 * 2 for i in range(n)}


def test_nulls_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", 7, 1), (1, "b", 7, 1), (2, "a", 8, 0), (2, "b", 8, 0), (None, "a", 1, 1), (None, "b", 1, 1), (3, None, 1, 1)], "article_id long, key string, df long, a long")
    assert [tuple(r) for r in overlap.links(rows).collect()] == [(1, 2)]


def test_families_of_near_copies_leave_nothing_to_pair(spark):
    families, copies, n = 12, 30, 20
    sets = {f * copies + c: {f"f{f}-{i}" for i in range(n) if i != c % n} | {f"edition{c}"} for f in range(families) for c in range(copies)}
    rows = overlap.counted(table(spark, sets), "article_id", "key")
    assert min(overlap.costs(rows).values()) > 10 * rows.count()  # all of it at once
    left = overlap.undecided(rows, overlap.by_neighbours(rows), 10_000)
    assert left.isEmpty()  # each family is one component, and an edition alone links none
    got = [(r.a, r.b) for r in overlap.links(table(spark, sets)).collect()]
    assert parts(got) == parts(all_pairs(sets)) and len(got) < families * copies * n
