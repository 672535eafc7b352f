"""Text functions that Spark's expressions cannot state, as Arrow-batched functions."""

import difflib
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THOUGHT = re.compile(r"<think>.*?</think>", re.S)
ALIKE, TITLES = 0.85, 50


def last_object(text: str | None) -> str | None:
    """The JSON that a model's answer holds: all of it, or the last balanced object in it that parses; else null.

    Braces are paired in one pass with a stack; objects are tried from the last closing brace backwards, and where one
    does not parse the search goes on before its opening brace.
    """
    text = THOUGHT.sub("", text or "").strip()
    try:
        return json.dumps(json.loads(text))
    except ValueError:
        pass
    opened, begins = [], {}
    for at, c in enumerate(text):
        if c == "{":
            opened.append(at)
        elif c == "}":
            begins[at] = opened.pop() if opened else -1
    before = len(text)
    for end in sorted(begins, reverse=True):
        if end >= before:
            continue
        if begins[end] < 0:
            return None
        try:
            return json.dumps(json.loads(text[begins[end] : end + 1]))
        except ValueError:
            before = begins[end]
    return None


def recover_json(text: Column) -> Column:
    """``last_object`` of each text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(last_object)

    return F.pandas_udf(run, "string")(text)


def role_text(answer: Column, role: str) -> Column:
    """What a model's JSON answer says of a role, at its top or under ``paragraph``; of a list the first; else null."""
    return F.coalesce(*[F.get_json_object(answer, f"$.{at}{role}{first}") for at in ("", "paragraph.") for first in ("[0]", "")])


def alike(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts, the first one's place being the first."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def near(title: str, known: Iterable[str], least: float = ALIKE) -> bool:
    """Whether a text is at least so alike to one of the known ones. Lengths and letters bound the likeness first."""
    match = difflib.SequenceMatcher(None, title)
    for other in known:
        if 2 * min(len(title), len(other)) >= least * (len(title) + len(other)):
            match.set_seq2(other)
            if match.quick_ratio() >= least and match.ratio() >= least:
                return True
    return False


def _near(a: Column, b: Column, least: float) -> Column:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([near(p, [q], least) for p, q in zip(x, y, strict=True)], dtype="bool")

    return F.pandas_udf(run, "boolean")(a, b)


def new_titles(rows: DataFrame, known: DataFrame, least: float = ALIKE, most: int = TITLES) -> DataFrame:
    """The rows (id, source_id, title, ...) without a similar title among their source's first ``most`` known ones.

    ``known`` is (source_id, title, at); a title is compared in lower case, and a row without one is new. Each row meets
    at most ``most`` titles, which is the feature, so pairs stay in proportion to the rows; those whose lengths are too
    far apart never reach the comparison.
    """
    first = Window.partitionBy("source_id").orderBy("at", "title")
    titles = known.where("title <> ''").withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    old = titles.select("source_id", F.col("title").alias("other"))
    pairs = rows.where("title <> ''").join(old, "source_id").select("id", "title", "other")
    pairs = pairs.select("id", F.lower(F.trim("title")).alias("a"), F.lower(F.trim("other")).alias("b"))
    long = F.length("a") + F.length("b")
    same = pairs.where(2 * F.least(F.length("a"), F.length("b")) >= least * long).where(_near(F.col("a"), F.col("b"), least)).select("id").distinct()
    return rows.join(same, "id", "left_anti")
