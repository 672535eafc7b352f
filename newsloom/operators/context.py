"""The context of chosen narratives for a reader or a model: their articles, first paragraphs, sources and text."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Context:
    narratives: DataFrame
    articles: DataFrame
    paragraphs: DataFrame
    trust: DataFrame
    totals: DataFrame
    text: DataFrame


def materialize_context(member: DataFrame, articles: DataFrame, trust: DataFrame, chosen: list[int], most_articles: int = 10, most_paragraphs: int = 10) -> Context:
    """What belongs to the chosen narratives (by cluster id); unknown ids are skipped, no ids give empty frames.

    Articles come in order of time, at most ``most_articles`` of a narrative, undated ones first, as an empty date
    sorts; paragraphs are lines with text. ``totals`` counts all members; the text is one row a narrative.
    """
    own = member.where(F.col("cluster_id").isin(*chosen) if chosen else F.lit(False)).select("cluster_id", "article_id", "source_id", "event_ts", "title")
    order = Window.partitionBy("cluster_id").orderBy(F.coalesce("event_ts", F.lit("")), "article_id")
    first = own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_articles)
    shown = first.join(articles.select("article_id", "text"), "article_id")
    lines = F.slice(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""), 1, most_paragraphs)
    paragraphs = shown.select("cluster_id", "article_id", F.posexplode(lines).alias("at", "paragraph"))
    sources = own.select("cluster_id", "source_id").distinct().join(trust, "source_id", "left")
    head = own.groupBy("cluster_id").agg(F.min_by("title", F.struct(F.coalesce("event_ts", F.lit("9999")), "article_id")).alias("title"), F.array_sort(F.collect_set("source_id")).alias("sources"), F.count("*").alias("member_count"))
    totals = own.agg(F.count_distinct("article_id").alias("total_articles")).crossJoin(first.agg(F.count_distinct("source_id").alias("total_sources")))
    said = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("["), "source_id", F.lit("] "), "text").alias("said")))), lambda x: x["said"])
    bodies = shown.groupBy("cluster_id").agg(said.alias("said")).join(head, "cluster_id")
    line = F.concat(F.lit("--- Narrative: "), F.col("title"), F.lit(" (sources: "), F.array_join("sources", ", "), F.lit(") ---"))
    text = bodies.select("cluster_id", F.array_join(F.concat(F.array(line), "said"), "\n\n").alias("context"))
    profile = sources.where("trust IS NOT NULL").select("source_id", "trust").distinct()
    return Context(head, shown, paragraphs, profile, totals, text)
