"""The registry of sources: a JSON map, of which some keys are settings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.storage import exists

#: Keys that are settings, not sources.
RESERVED = ("feeds", "seeds", "llm", "searxng", "crawler")
DEFAULT_TRUST = 0.5
_FIELDS = "struct<name:string,base_trust:double,url:string,kind:string,logo_url:string>"
SCHEMA = "source_id string, name string, base_trust double, url string, kind string, logo_url string"


def _text(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.text(path, wholetext=True) if exists(spark, path) else None


def load(spark: SparkSession, path: str) -> DataFrame:
    """``(source_id, name, base_trust, url, kind, logo_url)`` of a file's sources; none where there is no file."""
    raw = _text(spark, path)
    if raw is None:
        return spark.createDataFrame([], SCHEMA)
    rows = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("source_id", "body"))
    rows = rows.where(~F.col("source_id").isin(*RESERVED) & F.col("body").startswith("{"))
    rows = rows.select("source_id", F.from_json("body", _FIELDS).alias("f")).select("source_id", "f.*")
    return rows.withColumns({"name": F.coalesce("name", "source_id"), "base_trust": F.coalesce("base_trust", F.lit(DEFAULT_TRUST))})


def setting(spark: SparkSession, path: str, key: str) -> dict[str, str]:
    """One reserved key's map, empty where the file, the key or the JSON is missing or bad."""
    raw = _text(spark, path)
    if raw is None:
        return {}
    got = raw.select(F.from_json(F.from_json("value", "map<string,string>")[key], "map<string,string>").alias("m")).first()
    return dict(got.m) if got and got.m else {}


def search_provider(spark: SparkSession, path: str) -> dict[str, str] | None:
    """The search provider's settings, or None where it is switched off, missing or has no address."""
    found = setting(spark, path, "searxng")
    return found if found.get("url") and found.get("enabled", "true").lower() != "false" else None


def ensure(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with the sources of ``new`` that it lacks; those it has stay as they are."""
    return registry.unionByName(new.join(registry, "source_id", "left_anti").dropDuplicates(["source_id"]), allowMissingColumns=True)


def base_trust(rows: DataFrame, registry: DataFrame, default: float = DEFAULT_TRUST) -> DataFrame:
    """``rows`` with their source's base trust, or the default where the registry has none."""
    known = registry.select("source_id", "base_trust")
    return rows.join(known, "source_id", "left").withColumn("base_trust", F.coalesce("base_trust", F.lit(default)))


def overlay(config: dict[str, str], given: list[str]) -> dict[str, str]:
    """Feeds of the configuration under those given as ``source=url``, split at the first ``=``; the given ones win."""
    return config | {s.strip(): u.strip() for s, _, u in (g.partition("=") for g in given) if u}


def save(registry: DataFrame, path: str) -> None:
    """The registry as one JSON object, which ``load`` reads."""
    body = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", F.struct(*[c for c in registry.columns if c != "source_id"])))))
    registry.agg(F.to_json(body).alias("value")).coalesce(1).write.mode("overwrite").text(path)
