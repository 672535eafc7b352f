"""Hooks: results, errors, empty input, and how often a worker loads its model."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import hooks
from newsloom.functions.recover import recover_json, role_text


def counting(path):
    def load():
        import os
        import uuid

        with open(f"{path}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return lambda texts: [len(t) for t in texts]

    return load


def test_a_worker_loads_its_model_once(spark, tmp_path):
    hook = hooks.Hook(counting(str(tmp_path)), "int", batch=7)
    rows = spark.range(400).repartition(16).withColumn("text", F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")))
    for _ in range(2):
        got = rows.select("id", hook(F.col("text")).alias("h")).select("id", "h.*").collect()
        assert {r.id: r.result for r in got} == {i: i % 9 for i in range(400)} and not any(r.error for r in got)
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) and {int(x) for x in loads} >= {r.worker for r in got}


def fragile():
    seen = []

    def model(texts):
        seen.append(1)
        if any("bad" in t for t in texts):
            raise ValueError("cannot read")
        return [f'{{"who": "{t}"}}' for t in texts]

    return model


def test_one_bad_text_costs_one_row(spark):
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(["Ann", "bad", None, "", "Bob", "Cy"] * 5)], "id long, text string, who_error string").drop("who_error").coalesce(1)
    got = hooks.Hook(fragile, batch=8, wait=0).apply(rows, "text", "who").withColumn("role", role_text(recover_json(F.col("who")), "who")).orderBy("id").collect()
    assert [r.role for r in got] == ["Ann", None, None, "", "Bob", "Cy"] * 5
    assert [r.who_error for r in got] == [None, "ValueError: cannot read", None, None, None, None] * 5
    assert rows.columns == ["id", "text"] and got[0].asDict().keys() == {"id", "text", "who", "who_error", "role"}
    assert hooks.Hook(fragile).apply(rows.limit(0), "text", "who").count() == 0


def test_retries():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("busy")
        return texts if len(calls) < 5 else texts[:-1]

    assert hooks.answers(model, ["a", "b"], 2, 0) == [("a", None), ("b", None)] and calls == [2, 2, 2]
    calls.extend([0, 0])
    assert [e for _, e in hooks.answers(model, ["a", "b"], 0, 0)] == ["ValueError: 0 results for 1 texts"] * 2


@pytest.mark.parametrize("returns, value", [("array<float>", [0.5, 1.0]), ("string", "s"), ("double", 2.0)])
def test_types(spark, returns, value):
    hook = hooks.Hook(lambda: lambda texts: [value] * len(texts), returns)
    assert spark.createDataFrame([("a",)], "t string").select(hook(F.col("t")).alias("h")).first().h.result == value
