"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted into cells of source, language and topic, weighed by tokens. Raking multiplies the cells'
weights by target over actual share of each marginal in turn until all hold. A cell's weight over its tokens, times
one scale for all and 1 at most, is the probability with which its documents are drawn. A rare cell is drawn whole
where its target is more than it has: the scale is the largest with which the sample lacks, for that, at most ``SHORT``
of the tokens its targets ask for. So cells of few tokens, however rare, do not decide how much is drawn of the others.

Only cells are iterated on: they are as many as sources times a few, and a hot source is a few cells. Marginals are
partial aggregations and the joins back are equi-joins that Spark broadcasts when their measured size allows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.text import WORD, whole
from newsloom.storage import materialize

DIMS = ("source", "lang", "topic")
#: Exponent on a marginal's shares that gives its default target: 1 leaves it, 0 makes all values equal.
TEMPERATURE = 0.9
#: Share of a sample's target tokens that cells drawn whole may lack; 0 lets the rarest cell set the scale.
SHORT = 0.01
#: The scale is searched on a grid of so many points, which is narrowed so many times.
GRID, NARROWED = 32, 4
SEED = 20240101


def topic_of(text: Column) -> Column:
    """A stand-in for topic labels, by content and length of the text."""
    n = F.char_length(text)
    return (
        F.when(text.contains("Licensed under") | text.contains("rights reserved"), "legal")
        .when(text.contains("@"), "contact").when(n < 400, "brief").when(n < 2000, "short").when(n < 8000, "medium").otherwise("long")
    )


def _dims(docs: DataFrame, text_col: str) -> dict[str, Column]:
    own = {d: F.coalesce(F.col(d).cast("string"), F.lit("")) if d in docs.columns else None for d in DIMS}
    own["topic"] = own["topic"] if own["topic"] is not None else topic_of(whole(text_col))
    return {d: c if c is not None else F.lit("") for d, c in own.items()}


def _targets(cells: DataFrame, dim: str, given: dict[str, float] | None, temperature: float) -> DataFrame:
    """``(dim, share)`` with shares that add up to 1 over the values that are there."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0")
    if given is not None:
        pairs = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else F.create_map().cast("map<string,double>")
        sums = sums.withColumn("raw", F.coalesce(pairs[F.col(dim)].cast("double"), F.lit(0.0)))
    else:
        sums = sums.withColumn("raw", F.pow(F.col("t").cast("double"), F.lit(float(temperature))))
    total = sums.agg(F.sum("raw")).first()[0] or 1.0
    return sums.select(dim, (F.col("raw") / F.lit(float(total))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, temperature: float = TEMPERATURE, tol: float = 1e-7, max_rounds: int = 30) -> DataFrame:
    """Cells ``(source, lang, topic, tokens)`` with ``weight``, whose marginals are the targets' shares of all tokens.

    Cells without tokens get weight 0. Targets that name no value of a marginal, or only values without tokens, leave
    weights 0. Rounds end when no factor is off 1 by more than ``tol``, or after ``max_rounds`` where the targets
    contradict empty cells.
    """
    goal = {d: materialize(_targets(cells, d, (targets or {}).get(d), temperature), "target") for d in DIMS}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(max_rounds):
        off = F.lit(0.0)
        for d in DIMS:
            sums = now.groupBy(d).agg(F.sum("weight").alias("s")).where("s > 0").join(goal[d], d)
            factor = sums.select(d, (F.col("share") * F.lit(total) / F.col("s")).alias(f"f_{d}"))
            now = now.join(factor, d, "left").withColumn("weight", F.col("weight") * F.coalesce(f"f_{d}", F.lit(0.0)))
            off = F.greatest(off, F.abs(F.coalesce(F.col(f"f_{d}"), F.lit(1.0)) - 1))
        now = materialize(now.select(*cells.columns, "weight", off.alias("off")), "raked")
        worst = now.agg(F.max("off")).first()[0] or 0.0
        now = now.drop("off")
        if worst <= tol:
            break
    return now


def _scale(raked: DataFrame, short: float) -> float:
    """The largest scale with which cells drawn whole lack at most the share ``short``; each step is one aggregation."""
    most, weight, tokens = raked.where("g > 0").agg(F.max("g"), F.sum("weight"), F.sum("tokens")).first()
    if not most:
        return 1.0
    low = 1 / most
    high = max(low, tokens / (weight * (1 - short)))  # all cells drawn whole lack the share
    for _ in range(NARROWED):
        grid = [low * (high / low) ** (k / GRID) for k in range(GRID + 1)]
        lacks = raked.agg(*[F.sum(F.greatest(F.lit(c) * F.col("g") - 1, F.lit(0.0)) * F.col("tokens")).alias(f"s{k}") for k, c in enumerate(grid)]).first()
        within = [k for k, c in enumerate(grid) if lacks[k] <= short * c * weight]
        at = max(within, default=0)
        low, high = grid[at], grid[min(at + 1, GRID)]
    return low


def _calibrated(docs: DataFrame, text_col: str, targets: dict | None, temperature: float) -> DataFrame:
    """``(source, lang, topic, weight, probability)`` of every cell."""
    dims = _dims(docs, text_col)
    rows = docs.select(*[c.alias(d) for d, c in dims.items()], F.regexp_count(whole(text_col), F.lit(WORD)).alias("n"))
    cells = materialize(rows.groupBy(*DIMS).agg(F.sum("n").alias("tokens")), "cells")
    raked = rake(cells, targets, temperature).withColumn("g", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0)))
    drawn = F.least(F.lit(1.0), F.col("g") * F.lit(_scale(raked, SHORT)))
    return materialize(raked.select(*DIMS, F.col("g").alias("weight"), drawn.alias("probability")), "calibrated")


def uniform(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.xxhash64(F.col(id_col), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: dict | None = None, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens, weight, probability, sampled)`` of every row.

    A null source, language or topic is the empty name. Texts without words have no tokens; they share their cell's
    probability, which is 0 where the cell has no tokens at all. Rows that repeat a doc_id in one cell are drawn
    together. A table without a topic column gets topics by ``topic_of``. No rows: an empty result.
    """
    cells = _calibrated(docs, text_col, targets, temperature)
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(d) for d, c in _dims(docs, text_col).items()], F.regexp_count(whole(text_col), F.lit(WORD)).cast("long").alias("n_tokens"))
    return rows.join(cells, list(DIMS)).select("doc_id", *DIMS, "n_tokens", "weight", "probability", (uniform() < F.col("probability")).alias("sampled"))


def draw(docs: DataFrame, targets: dict | None = None, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled documents, with their columns."""
    own = "_mix"
    while any(c.lower().startswith(own) for c in docs.columns):  # columns of the input keep their names
        own += "_"
    cells = _calibrated(docs, text_col, targets, temperature).select(*[F.col(d).alias(f"{own}_cell_{d}") for d in DIMS], F.col("probability").alias(f"{own}_p"))
    rows = docs.withColumns({f"{own}_{d}": c for d, c in _dims(docs, text_col).items()})
    same = [F.col(f"{own}_{d}") == F.col(f"{own}_cell_{d}") for d in DIMS]
    return rows.join(cells, same).where(uniform(id_col) < F.col(f"{own}_p")).select(*[F.col(f"`{c}`") for c in docs.columns])
