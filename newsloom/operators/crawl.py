"""Bounded breadth-first crawl over a table of links."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.storage import discard, materialize


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int, allowed: Column | None = None) -> DataFrame:
    """``(node, depth)`` of the pages fetched from ``seeds`` (node) over ``links`` (src, dst), level by level.

    No page is fetched twice or when ``allowed`` (over ``node``, as robots rules give it) is not true, and nothing
    beyond ``max_depth`` links. Within a level pages come in order of their name; once ``max_pages`` are fetched the
    crawl ends. Each level is one join with the level before and an anti-join with all pages seen, both written.
    """
    rule = allowed if allowed is not None else F.lit(True)
    level = seeds.select("node").where(F.col("node").isNotNull()).distinct()
    seen, count = None, 0
    for depth in range(max_depth + 1):
        fresh = level.where(rule)
        fresh = fresh.join(seen, "node", "left_anti") if seen is not None else fresh
        own = materialize(fresh.orderBy("node").limit(max_pages - count).withColumn("depth", F.lit(depth)), "level", free=False)
        new = own.count()
        before, seen = seen, materialize(seen.unionByName(own) if seen is not None else own, "seen", free=False)
        count += new
        if not new or count >= max_pages or depth == max_depth:
            discard(before, own)
            break
        level = materialize(links.join(own.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct(), "next", free=False)
        discard(before, own)
    return seen


def robots_rules(rows: DataFrame) -> DataFrame:
    """``(host, prefix)`` that robots files (host, text) close to every agent: ``Disallow`` lines under ``User-agent: *``."""
    lines = rows.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    lines = lines.select("host", "at", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]*:([^#]*)", 1)).alias("value"))
    agents = F.struct("at", "key", "value")
    parts = lines.where("key IN ('user-agent', 'disallow')").groupBy("host").agg(F.array_sort(F.collect_list(agents)).alias("all"))
    last = F.aggregate(
        "all", F.struct(F.lit(False).alias("star"), F.lit(False).alias("ruled"), F.expr("CAST(array() AS array<string>)").alias("closed")),
        lambda acc, x: F.when(
            x["key"] == "user-agent",
            F.struct(((x["value"] == "*") | (acc["star"] & ~acc["ruled"])).alias("star"), F.lit(False).alias("ruled"), acc["closed"].alias("closed")),
        ).otherwise(F.struct(
            acc["star"].alias("star"), F.lit(True).alias("ruled"),
            F.when(acc["star"] & (x["value"] != ""), F.concat(acc["closed"], F.array(x["value"]))).otherwise(acc["closed"]).alias("closed"),
        )),
    )
    return parts.select("host", F.explode(last["closed"]).alias("prefix"))


def may_fetch(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The pages (url, ...) that have a host and whose path no rule of that host closes; hosts without rules are open."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    rows = pages.withColumns({"_host": host, "_path": F.when(path == "", "/").otherwise(path)}).where("_host <> ''")
    closed = rules.select(F.col("host").alias("_rule"), "prefix")
    return rows.join(closed, (F.col("_host") == F.col("_rule")) & F.col("_path").startswith(F.col("prefix")), "left_anti").drop("_host", "_path")
