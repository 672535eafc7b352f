"""Search for narratives by roles: how well a role fits a text, and which narratives hold all or any of several texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.storage import materialize

EXACT, CONTAINED, OVERLAP_BASE, OVERLAP_STEP, LEAST_OVERLAP = 1.0, 0.95, 0.8, 0.15, 0.5
UNKNOWN_TRUST, NEVER = 0.5, 9999


def match_score(norm: Column, wanted: Column) -> Column:
    """How a role's normalised text fits a wanted one: equal, one inside the other, or half their words; else null."""
    a, b = F.array_distinct(F.split(norm, " ")), F.array_distinct(F.split(wanted, " "))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    inside = norm.contains(wanted) | wanted.contains(norm)
    overlap = F.when(share >= LEAST_OVERLAP, F.lit(OVERLAP_BASE) + F.lit(OVERLAP_STEP) * share)
    return F.when(norm == wanted, EXACT).when(inside, CONTAINED).otherwise(F.when((norm != "") & (wanted != ""), overlap))


def match_roles(roles: DataFrame, texts: list[str]) -> DataFrame:
    """``(spec, role_id, norm, score)``: the roles that fit each text, whose number is ``spec``.

    One scan of the roles: the texts travel as literals, and only what fits is moved. No texts, or nothing that fits: no rows.
    """
    wanted = F.array(*[F.struct(F.lit(i).alias("spec"), T.normalize(F.lit(t)).alias("text")) for i, t in enumerate(texts)])
    rows = roles.select("role_id", "norm")
    if not texts:
        return rows.select(F.lit(0).alias("spec"), "role_id", "norm", F.lit(0.0).alias("score")).limit(0)
    rows = rows.select("role_id", "norm", F.explode(wanted).alias("w"))
    scored = rows.select("w.spec", "role_id", "norm", F.round(match_score(F.col("norm"), F.col("w.text")), 6).alias("score"))
    return scored.where("score IS NOT NULL").distinct()


def narrative_trust(member: DataFrame, trust: DataFrame) -> DataFrame:
    """``(cluster_id, trust)``: the mean over a narrative's distinct sources; unknown sources count as a half."""
    own = member.select("cluster_id", "source_id").distinct().join(trust, "source_id", "left")
    return own.groupBy("cluster_id").agg(F.avg(F.coalesce("trust", F.lit(UNKNOWN_TRUST))).alias("trust"))


def two_places(x: Column) -> Column:
    """Rounded half up as a decimal number, so that 0.565 is 0.57 whatever its binary digits."""
    return F.round(x.cast("decimal(18,9)"), 2).cast("double")


def days_since(sec: Column, now: int) -> Column:
    """Whole days before ``now``, none for the future, many where the time is missing."""
    return F.when(sec.isNull(), NEVER).otherwise(F.greatest(F.lit(0), F.floor((F.lit(now) - sec) / 86400))).cast("int")


def order_of(ranking: str) -> list[Column]:
    """The sort order of a ranking; an unknown name ranks by trust. Ties go by narrative."""
    fresh = F.round(F.col("trust_score") * 0.6 + F.lit(0.4) / (F.col("days") + 1), 9)
    first = {
        "trust_recency": [fresh.desc()], "recency": [F.col("latest").desc_nulls_last()], "sources": [F.desc("source_count")],
        "frame": [F.coalesce("shifted", F.lit(False)), F.desc("trust_score")],
    }.get(ranking, [F.desc("trust_score")])
    return [*first, F.col("cluster_id")]


def find_narratives(
    member: DataFrame, role: DataFrame, trust: DataFrame, texts: list[str], now: int, require_all: bool = True,
    min_trust: float = 0.0, limit: int = 20, ranking: str = "trust_recency", frames: DataFrame | None = None,
) -> DataFrame:
    """``(cluster_id, satisfied, total, trust_score, source_count, latest, days)`` of the best narratives.

    A narrative holds a text if one of its articles has a role that fits it. With ``require_all`` it must hold all,
    and a text that no role fits leaves nothing; otherwise one is enough, and ``total`` counts texts that any role
    fits. ``frames`` (cluster_id, shifted) is needed by the ranking "frame" alone. No texts: no rows.
    """
    fits = materialize(match_roles(role, texts).select("spec", "role_id"), "fits", free=False)
    held = role.select("role_id", "article_id").join(fits, "role_id").join(member.select("article_id", "cluster_id"), "article_id")
    held = held.groupBy("cluster_id").agg(F.count_distinct("spec").alias("satisfied"))
    held = held.crossJoin(F.broadcast(fits.agg(F.count_distinct("spec").alias("total"))))
    held = held.where(F.col("satisfied") == len(texts)) if require_all else held
    about = member.groupBy("cluster_id").agg(F.count_distinct("source_id").alias("source_count"), F.max("event_ts").alias("latest"), F.max("event_sec").alias("sec"))
    rows = held.join(about, "cluster_id").join(narrative_trust(member, trust), "cluster_id").where(F.round("trust", 9) >= min_trust)
    rows = rows.withColumns({"trust_score": two_places(F.col("trust")), "days": days_since(F.col("sec"), now)})
    rows = rows.join(frames, "cluster_id", "left") if frames is not None else rows.withColumn("shifted", F.lit(False))
    return rows.orderBy(*order_of(ranking)).limit(limit).select("cluster_id", "satisfied", "total", "trust_score", "source_count", "latest", "days")
