"""Sets that share two keys or more, linked without a row for each two of them.

A key in few sets is joined with itself: its pairs are few. A key in many sets is not. A set puts each of its frequent
keys together with each of its other keys, and all sets with the same two keys are linked to the smallest of them: a row
for each set, where the join would make the square of them. Two sets that share two keys either share two rare ones,
which the join counts, or have such a couple in common, so no link between components is lost.

Before that, sets are linked by the neighbours among their sorted keys: a row for each key, and near copies have most of
them in common. A key that only sets of one component have can link no others, and of sets of one component with the
same other keys one is enough. What is left decides about the rest, so families of near copies make no pairs.

From which frequency on a key counts as frequent is decided by the work: one pass over the keys adds up, for each power
of two, the pairs of the join and the couples of the sets, and the least sum is taken. The result is the same for any.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.graph import connected_components
from newsloom.storage import materialize

#: Bounds between rare and frequent keys that are compared: powers of two up to this one.
POWERS = 24
#: A couple is shuffled twice and is wider than a pair.
COUPLE_COST = 3.0


def counted(rows: DataFrame, item: str, key: str) -> DataFrame:
    """``(a, key, df)``: each set's keys that another set has too, with the number of sets that have them."""
    own = rows.select(F.col(item).alias("a"), F.col(key).alias("key")).where("a IS NOT NULL AND key IS NOT NULL")
    df = own.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    return own.join(df, "key").select("a", "key", "df")


def costs(rows: DataFrame) -> dict[int, float]:
    """For each bound the rows that rare keys (at most so many sets) and couples with frequent ones would make."""
    bounds = [1 << j for j in range(POWERS + 1)]
    above = [F.count_if(F.col("df") > b).cast("double").alias(f"h{b}") for b in bounds]
    rare = [F.sum(F.when(F.col("df") <= b, (F.col("df") - 1) / 2.0).otherwise(0.0)).alias(f"p{b}") for b in bounds]
    sets = rows.groupBy("a").agg(F.count("*").cast("double").alias("k"), *above, *rare)
    couples = lambda h: (F.col(h) * (F.col("k") - F.col(h)) + F.col(h) * (F.col(h) - 1) / 2) * COUPLE_COST
    total = sets.agg(*[F.sum(F.col(f"p{b}") + couples(f"h{b}")).alias(str(b)) for b in bounds]).first()
    return {b: total[str(b)] or 0.0 for b in bounds}


def by_couples(rows: DataFrame, bound: int) -> DataFrame:
    """``(a, b)``: links of the sets that have a frequent key and another key in common, to the smallest such set."""
    frequent = F.col("df") > bound
    packed = rows.groupBy("a").agg(
        F.array_sort(F.collect_list(F.when(frequent, F.col("key")))).alias("often"), F.collect_list(F.when(~frequent, F.col("key"))).alias("seldom"),
    )
    one = packed.where(F.size("often") > 0).select("a", "often", "seldom", F.posexplode("often").alias("at", "key"))
    others = F.concat(F.expr("slice(often, at + 2, size(often))"), F.col("seldom"))
    two = one.select("a", "key", F.explode(others).alias("other"))
    return _first_with_both(two.select("a", F.least("key", "other").alias("k1"), F.greatest("key", "other").alias("k2")))


def by_neighbours(rows: DataFrame) -> DataFrame:
    """``(a, b)``: links of the sets that have two keys in common which are neighbours in both, to the smallest such set."""
    packed = rows.groupBy("a").agg(F.array_sort(F.collect_list("key")).alias("keys")).where(F.size("keys") >= 2)
    two = packed.select("a", F.posexplode("keys").alias("at", "k1"), "keys").where(F.col("at") < F.size("keys") - 1)
    return _first_with_both(two.select("a", "k1", F.expr("keys[at + 1]").alias("k2")))


def _first_with_both(two: DataFrame) -> DataFrame:
    """``(a, b)``: each set of (a, k1, k2) with the smallest set that has the same two keys."""
    two = materialize(two, "couples", free=False)
    first = two.groupBy("k1", "k2").agg(F.min("a").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = two.join(first, ["k1", "k2"]).where("a <> first")
    return met.select(F.col("first").alias("a"), F.col("a").alias("b")).distinct()


def by_pairs(rows: DataFrame, bound: int) -> DataFrame:
    """``(a, b)``: the pairs a < b that share two keys of at most ``bound`` sets each."""
    rare = rows.where(F.col("df") <= bound)
    left, right = rare.select("key", "a"), rare.select("key", F.col("a").alias("b"))
    return left.join(right, "key").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2").select("a", "b")


def undecided(rows: DataFrame, near: DataFrame, small: int = 0) -> DataFrame:
    """``(a, key, df)``: what can still link sets of different components of the links ``near``.

    Keys that only one component has are left out, sets with fewer than two others too, and of the sets of a component
    that have the same others all but the smallest.
    """
    label = connected_components(near, small=small).select(F.col("node").alias("a"), "component")
    placed = materialize(rows.join(label, "a", "left").select("a", "key", F.coalesce("component", "a").alias("c")), "placed", free=False)
    open_keys = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    left = materialize(placed.join(open_keys, "key", "left_semi"), "undecided", free=False)
    same = F.sha2(F.array_join(F.array_sort(F.collect_list(F.hex(F.col("key").cast("binary")))), ","), 256).alias("same")
    sets = left.groupBy("a").agg(F.first("c").alias("c"), same, F.count("*").alias("k")).where("k >= 2")
    kept = sets.groupBy("c", "same").agg(F.min("a").alias("a")).select("a")
    return counted(left.join(kept, "a", "left_semi"), "a", "key")


def links(rows: DataFrame, item: str = "article_id", key: str = "key", bound: int | None = None, small: int = 0) -> DataFrame:
    """``(a, b)``, a < b: links whose components are those of all pairs of sets that share two keys or more.

    ``rows`` has each key of each set once; rows with a null are left out, and no rows have no links. Every link is
    between two sets that do share two keys. ``bound`` fixes where keys begin to be frequent; else the work decides.
    ``small`` is that of ``connected_components``.
    """
    own = materialize(counted(rows, item, key), "keys", free=False)
    near = materialize(by_neighbours(own), "near", free=False)
    own = materialize(undecided(own, near, small), "keys", free=False)
    if bound is None:
        known = costs(own)
        bound = min(known, key=lambda b: (known[b], -b))
    pairs = near.unionByName(by_pairs(own, bound))
    if own.where(F.col("df") > bound).isEmpty():
        return pairs
    return pairs.unionByName(by_couples(own, bound))
