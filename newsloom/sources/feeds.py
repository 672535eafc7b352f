"""Feeds and article files as DataFrames of articles."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T

ARTICLE = ("source_id", "text", "url", "title", "author", "published", "image_url", "video_url")
_MEDIA = "array<struct<_url:string,_medium:string,_type:string>>"
_THUMBS = "array<struct<_url:string>>"
#: What is read of an RSS item or an Atom entry; names keep their prefixes.
_SCHEMA = f"""
    title string, link array<struct<_VALUE:string,_href:string,_rel:string>>, author array<struct<_VALUE:string,name:string>>,
    `dc:creator` string, description string, summary struct<_VALUE:string>, `content:encoded` array<string>, content array<struct<_VALUE:string>>,
    pubDate string, published string, updated string, `media:content` {_MEDIA}, `media:thumbnail` {_THUMBS},
    `media:group` array<struct<`media:thumbnail`:{_THUMBS}>>, enclosure {_MEDIA}"""
PICTURE = r"(?i)\.(jpg|jpeg|png|webp|gif)$"


def feed_image(media: Column, thumbnails: Column, groups: Column, enclosures: Column) -> Column:
    """A feed entry's picture: of its media, thumbnails, grouped thumbnails and enclosures the first that names one."""
    shown = lambda m: (m["_medium"] == "image") | m["_url"].rlike(PICTURE)
    attached = lambda e: e["_url"].isNotNull() & (e["_type"].startswith("image/") | e["_url"].rlike(PICTURE))
    named = lambda t: F.coalesce(t["_url"], F.lit("")) != ""
    grouped = F.flatten(F.transform(groups, lambda g: F.coalesce(g["media:thumbnail"], F.array().cast(_THUMBS))))
    first = lambda found: F.get(found, F.lit(0))["_url"]
    return F.coalesce(first(F.filter(media, shown)), first(F.filter(thumbnails, named)), first(F.filter(grouped, named)), first(F.filter(enclosures, attached)))


def feed_video(link: Column, media: Column) -> Column:
    """The embedding URL of the entry's link where a video host is known, else its first video."""
    clip = F.filter(media, lambda m: (m["_medium"] == "video") | m["_type"].startswith("video/"))
    return F.coalesce(T.video_embed(link), F.get(clip, F.lit(0))["_url"])


def in_window(published: Column, since: str | None, before: str | None) -> Column:
    """Whether a date lies in the window; dates that are missing or not understood do. A day as the end means all of it."""
    when = F.coalesce(T.mail_time(published), T.iso_time(published))
    ends = before + "T23:59:59Z" if before and len(before) <= 10 else before
    rules = [when >= F.coalesce(T.mail_time(F.lit(since)), T.iso_time(F.lit(since)))] if since else []
    rules += [when <= F.coalesce(T.mail_time(F.lit(ends)), T.iso_time(F.lit(ends)))] if ends else []
    inside = F.lit(True)
    for rule in rules:
        inside = inside & F.coalesce(rule, F.lit(True))
    return inside


def read_feed(spark: SparkSession, path: str, source_id: str, since: str | None = None, before: str | None = None) -> DataFrame:
    """Articles of the RSS and Atom files under ``path``: an entry's summary and contents are its text, blank ones go."""

    def entries(tag: str) -> DataFrame:
        return spark.read.format("xml").schema(_SCHEMA).option("rowTag", tag).option("mode", "PERMISSIVE").load(path)

    rows = entries("item").unionByName(entries("entry"))
    return _articles(rows.withColumn("source_id", F.lit(source_id)), since, before)


def articles_of(fetched: DataFrame, since: str | None = None, before: str | None = None) -> DataFrame:
    """Articles of fetched feeds (source_id, body): RSS, RSS 1.0 and Atom; a body that is none of these has none."""
    item = f"array<struct<{_SCHEMA}>>"
    root = F.from_xml("body", f"channel struct<item {item}>, item {item}, entry {item}")
    rows = fetched.where("body IS NOT NULL").select("source_id", root.alias("x"))
    none = F.array().cast(item)
    each = F.concat(*[F.coalesce(c, none) for c in (F.col("x.channel.item"), F.col("x.item"), F.col("x.entry"))])
    return _articles(rows.select("source_id", F.inline(each)), since, before)


def _articles(rows: DataFrame, since: str | None, before: str | None) -> DataFrame:
    summary = F.coalesce("description", F.col("summary._VALUE"), F.lit(""))
    more = F.coalesce(F.col("`content:encoded`"), F.transform("content", lambda c: c["_VALUE"]), F.array().cast("array<string>"))
    parts = F.filter(F.concat(F.array(summary, F.array_join(more, "\n\n"))), lambda p: F.trim(p) != "")
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.get(own, F.lit(0))["_href"], F.get(own, F.lit(0))["_VALUE"])
    author = F.get("author", F.lit(0))
    rows = rows.withColumns({"url": link, "body": F.trim(F.array_join(parts, "\n\n")), "when": F.coalesce("published", "pubDate", "updated")})
    rows = rows.where((F.col("body") != "") & in_window(F.col("when"), since, before))
    return rows.select(
        "source_id", F.col("body").alias("text"), "url", "title",
        F.coalesce(author["name"], author["_VALUE"], F.col("`dc:creator`")).alias("author"), F.col("when").alias("published"),
        feed_image(F.col("`media:content`"), F.col("`media:thumbnail`"), F.col("`media:group`"), F.col("enclosure")).alias("image_url"),
        feed_video(F.col("url"), F.col("`media:content`")).alias("video_url"),
    )


def read_articles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Articles of a file: one JSON object a line (``.jsonl``), a list, ``{"articles": [...]}`` or a single object.

    Blank lines are skipped; rows that are not JSON fail the job, as a file that is half read would go unnoticed.
    """
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wrapped = spark.read.schema(f"articles array<struct<{schema}>>, {schema}").option("multiLine", "true").option("mode", "FAILFAST").json(path)
    alone = wrapped.where("articles IS NULL").drop("articles")
    return alone.unionByName(wrapped.where("articles IS NOT NULL").select(F.inline("articles")))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; blank and corrupt lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def search_articles(results: DataFrame) -> DataFrame:
    """Articles of web search results (n, url, title, content, publishedDate, metadata, img_src, thumbnail, image).

    Only http links with a title or a snippet; of a URL that comes twice the first (by ``n``) stays.
    """
    usable = F.col("url").startswith("http") & ((F.trim(F.coalesce("title", F.lit(""))) != "") | (F.trim(F.coalesce("content", F.lit(""))) != ""))
    rows = results.where(usable)
    first = rows.groupBy("url").agg(F.min_by(F.struct(*rows.columns), "n").alias("r")).select("r.*")
    pictures = [F.when(F.col(c).startswith("http"), F.col(c)) for c in ("img_src", "thumbnail", "image")]
    return first.select(
        "n", "url", "title", F.col("content").alias("text"), F.nullif(F.trim("publishedDate"), F.lit("")).alias("published"),
        T.author(F.col("metadata")).alias("author"), F.coalesce(*pictures).alias("image_url"), T.video_embed(F.col("url")).alias("video_url"),
        F.regexp_replace(T.domain(F.col("url")), r"^www\.", "").alias("source_id"),
    )


def paged(pages: list[DataFrame], most: int) -> DataFrame:
    """Result pages in order, until ``most`` rows are reached."""
    rows = [p.withColumn("_page", F.lit(i)) for i, p in enumerate(pages)]
    all_of = rows[0]
    for p in rows[1:]:
        all_of = all_of.unionByName(p)
    return all_of.orderBy("_page", "n").limit(most).drop("_page")
