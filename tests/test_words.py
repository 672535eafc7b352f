"""Words counted inside their articles."""

from newsloom.plans import views


def test_words_are_counted_without_a_row_for_each_in_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "b a B c"), (1, "a"), (2, ""), (3, None), (None, "x x"), (4, "z")], "article_id long, text string")
    got = views._token(rows)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", 2), (1, "b", 2), (1, "c", 1), (4, "z", 1), (None, "x", 2)]
    dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not any("term" in x for x in dealt)
