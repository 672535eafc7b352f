"""Every catalogue query against its oracle on the smallest tables; text functions against plain Python."""

import glob
import os
import random
import re

import duckdb
import pytest

from newsloom.functions import text as T
from newsloom.operators.graph import connected_components
from newsloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _row(values):
    return tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_oracle(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    ours = sorted(_row(r[c] for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert ours == sorted(_row(r[i] for i in at) for r in want.fetchall())


def test_normalize(spark):
    cases = {"Mr. Smith's House": "smith house", "Mrs Smith": "s smith", "general store": "eral store", "drone": "one", "The Zoës' café!": "the zoës café", "  a   b ": "a b"}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string").select("want", T.normalize(df_col("raw")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_boilerplate(spark):
    texts = ["Subscribe  now", "plain words here", "© 2024", "http://a.b/c?d=e&f=g#h[]@!$()", "Click here", "ms  now"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.is_boilerplate(df_col("t")).alias("b"))
    assert [r.b for r in df.collect()] == [True, False, True, True, True, True]
    assert re.search(T.BOILERPLATE[0], "subscribe to")


def test_components_equal_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, x) for x in range(5001, 5200)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(df.limit(0)).count() == 0
    assert {r.node: r.component for r in connected_components(df, small=10_000).collect()} == got
    assert connected_components(df.limit(0), small=10_000).count() == 0
    names = df.selectExpr("concat('n', a) AS a", "concat('n', b) AS b")
    rounds, task = ({r.node: r.component for r in connected_components(names, small=n).collect()} for n in (0, 10_000))
    assert rounds == task and len(task) == len(root)
