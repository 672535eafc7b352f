"""Trust of sources: base trust moved by how far a source's articles agree with those of others on common narratives."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGREE, STEP = 0.85, 0.1


def agreement(member: DataFrame, vectors: DataFrame, least: float = AGREE) -> DataFrame:
    """``(source_id, related, agreeing)``: common narratives with other sources, and those where the two agree.

    Two sources agree on a narrative if the mean cosine over all pairs of their articles there is ``least`` or more.
    That mean is the product of the two means of unit vectors, so no pair of articles is ever formed. ``vectors`` is
    (article_id, x); articles without one do not count.
    """
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)) + F.lit(1e-10)
    unit = vectors.select("article_id", F.transform("x", lambda v: v.cast("double") / norm).alias("x"))
    parts = member.select("cluster_id", "source_id", "article_id").join(unit, "article_id").select("cluster_id", "source_id", F.posexplode("x").alias("k", "v"))
    mean = parts.groupBy("cluster_id", "source_id", "k").agg(F.avg("v").alias("v"))
    left, right = mean.withColumnRenamed("source_id", "source"), mean.select("cluster_id", "k", F.col("source_id").alias("other"), F.col("v").alias("w"))
    both = left.join(right, ["cluster_id", "k"]).where("source <> other")
    cos = both.groupBy("cluster_id", "source", "other").agg(F.round(F.sum(F.col("v") * F.col("w")), 9).alias("cos"))
    return cos.groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("related"), F.count_if(F.col("cos") >= least).alias("agreeing"))


def update(base: DataFrame, agreed: DataFrame) -> DataFrame:
    """``(source_id, base_trust, related, agreeing, contradicting, corroborated, adjusted_trust)`` of every source.

    Adjusted trust is base trust plus up to a tenth either way, within 0 and 1; it starts from the base each time, so
    a second update changes nothing. A source that shares no narrative keeps its base trust.
    """
    rows = base.select("source_id", F.col("trust").alias("base_trust")).join(agreed, "source_id", "left").fillna(0, ["related", "agreeing"])
    share = F.when(F.col("related") > 0, F.col("agreeing") / F.col("related"))
    moved = F.when(share.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("base_trust") + STEP * (2 * share - 1))))
    return rows.select(
        "source_id", "base_trust", "related", "agreeing", (F.col("related") - F.col("agreeing")).alias("contradicting"),
        F.round(share, 6).alias("corroborated"), F.round(F.coalesce(moved, "base_trust"), 6).alias("adjusted_trust"),
    )


def board(updated: DataFrame) -> DataFrame:
    """The report over all sources, most trusted first: the columns of ``update`` and the shift."""
    shift = F.round(F.col("adjusted_trust") - F.col("base_trust"), 6).alias("shift")
    return updated.select("*", shift).orderBy(F.desc("adjusted_trust"), "source_id")


def latest(rows: DataFrame, order: str) -> DataFrame:
    """``(source_id, trust)``: of several trust rows of a source the last in ``order``."""
    return rows.groupBy("source_id").agg(F.max_by("trust", order).alias("trust"))
