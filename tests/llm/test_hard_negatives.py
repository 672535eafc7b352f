"""Hard negatives against plain loops over all pairs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows: list[tuple], positives: int = 5, negatives: int = 10) -> list[tuple]:
    live = [
        (n, NO if i is None else i, label, [math.floor(256 * float(x)) for x in v])
        for n, (i, v, label) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)
    ]
    hold = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    out = []
    for n, i, label, v in live:
        if i == NO or i % 100:
            continue
        scored = sorted((-hold(sum(x * y for x, y in zip(v, w, strict=True))), j, m, k) for m, j, k, w in live if m != n and len(w) == len(v))
        for p, j, _, _ in [s for s in scored if s[3] == label][:positives]:
            p = -p
            fit = [s for s in scored if s[3] != label and 30 * p <= -100 * s[0] <= 90 * p][:negatives]
            out += [(i, None if j == NO else j, r + 1, None if s[1] == NO else s[1], p, -s[0]) for r, s in enumerate(fit)]
    return sorted(out, key=str)


NO = 2**63 - 1


def mined(spark, rows, partitions=3, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions, "vec_id")
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect()), key=str)


def table(n, d=6, labels=3, seed=1, step=20, grain=4):
    rng = np.random.default_rng(seed)
    return [(i * step, [float(x) / grain for x in rng.integers(-8, 20, d)], int(rng.integers(labels))) for i in range(n)]


def test_equals_all_pairs(spark):
    rows = table(300)
    assert brute(rows)
    assert mined(spark, rows) == brute(rows)


def test_ties_and_a_hot_vector(spark):
    rows = table(60, grain=8) + [(10_000 + 20 * i, [1.0] * 6, i % 3) for i in range(150)]
    assert mined(spark, rows, 5) == brute(rows)


def test_several_passes_and_tiles(spark, monkeypatch):
    rows = table(200, seed=5)
    for name, value in (("PASS_BYTES", 600), ("TILE_ANCHORS", 3), ("TILE_CANDIDATES", 7)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = table(40) + [
        (4100, None, 1), (4200, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (4300, [nan] * 6, 1), (4400, [inf] * 6, 0), (4500, [1.0] * 6, None),
        (4600, [], 0), (4700, [], 0), (4800, [2.0, 3.0], 1), (4900, [2.0, 3.5], 1), (4901, [1.5, 2.0], 2), (None, [3.0] * 6, 1), (None, [3.0] * 6, 2),
        (-100, [2.0, 1.0, 0.5, 3.0, 2.0, 2.0], 1), (0, [0.0] * 6, 1),
    ]
    assert mined(spark, rows) == brute(rows)


def test_repeated_rows_are_rows(spark):
    rows = table(30) + table(30)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()), key=str)
    assert got == brute(rows)


def test_beyond_exact_floats(spark):
    rng = np.random.default_rng(7)
    rows = [(10 * i, [float(x) for x in rng.integers(1, 2**20, 4)], i % 2) for i in range(40)]  # products of some 2^58
    rows += [(1000, [1e15] * 4, 0), (1010, [1e15] * 4, 1), (1020, [1e15] * 4, 0)]  # products beyond 64 bits
    assert mined(spark, rows) == brute(rows)


def test_empty_extra_columns_and_query(spark, sf, tmp_path):
    assert mined(spark, []) == []
    df = spark.createDataFrame(table(40), SCHEMA).withColumn("row", F.lit("x")).withColumn("id", F.lit(1)).withColumn("is_anchor", F.lit(False))
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()), key=str)
    assert got == brute(table(40))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_query_equals_its_oracle(spark, size):
    at = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op11_hard_negatives"]).fetchall())
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, at).collect())) == want and want
