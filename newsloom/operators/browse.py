"""Lists of narratives: named ranges of dates, screens, orders and pages; the roles of narratives."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T

MOST_PER_PAGE = 100
#: What a list is ordered by: column and whether the largest comes first. An unknown name means ``latest``.
ORDERS = {"newest": ("first_seen", True), "updated": ("last_updated", True), "oldest": ("first_seen", False), "sources": ("n_sources", True), "latest": ("latest", True)}
#: Orders of a screened list; others leave it as it was.
SCREEN_ORDERS = {"newest": ("latest", True), "oldest": ("latest", False), "sources-desc": ("n_sources", True), "sources-asc": ("n_sources", False)}
DAYS = {"last_week": 7, "last_month": 30, "last_year": 365}


def in_range(name: str, date: Column, now: str) -> Column:
    """Whether a date text lies in a named range before ``now`` (UTC); a date that is missing or not understood does.

    Today and yesterday are days, the others so many days back from the moment.
    """
    moment, when = F.to_timestamp(F.lit(now)), T.iso_time(date)
    day = F.date_trunc("day", moment)
    if name == "today":
        fits = when >= day
    elif name == "yesterday":
        fits = (when >= day - F.expr("INTERVAL 1 DAY")) & (when < day)
    elif name in DAYS:
        fits = when >= moment - F.expr(f"INTERVAL {DAYS[name]} DAY")
    else:
        return F.lit(True)
    return F.coalesce(fits, F.lit(True))


def cutoff(name: str, now: str) -> Column | None:
    """Where a screen's range begins: months and years are those of the calendar, and the day of the month is counted on
    from the first, so 31 March less a month is 2 or 3 March. None for other names.
    """
    moment = F.to_timestamp(F.lit(now))
    day, first = F.date_trunc("day", moment), F.trunc(moment, "month")
    back = lambda months: F.date_add(F.add_months(first, -months), F.dayofmonth(moment) - 1).cast("timestamp")
    return {"today": day, "yesterday": day - F.expr("INTERVAL 1 DAY"), "last_week": moment - F.expr("INTERVAL 7 DAY"), "last_month": back(1), "last_year": back(12)}.get(name)


def screen(narratives: DataFrame, now: str, min_sources: int = 0, since: str = "", source: str = "") -> DataFrame:
    """Narratives (n_sources, sources: joined by commas, latest) with so many sources, a date in the range and a source that holds the text.

    A range has no end here, and narratives without a date are in none.
    """
    rows = narratives.where(F.col("n_sources") >= min_sources) if min_sources > 0 else narratives
    begin = cutoff(since, now)
    if begin is not None:
        rows = rows.where(T.iso_time(F.col("latest")) >= begin)
    return rows.where(F.exists(F.split("sources", ","), lambda s: s.contains(source))) if source else rows


@dataclass
class Page:
    rows: DataFrame
    page: int
    per_page: int
    total: int
    total_pages: int


def page_of(narratives: DataFrame, sort: str = "newest", page: int = 1, per_page: int = 20, key: str = "cluster_id", orders: dict[str, tuple[str, bool]] = ORDERS) -> Page:
    """One page in an order, with ``place`` from 1 in it. Missing dates are the smallest; ties go by the key.

    ``per_page`` is held between 1 and 100, ``page`` at 1 or more; past the end a page is empty. Only the rows up to the
    page's end are kept in any task.
    """
    column, falling = orders.get(sort, ORDERS["latest"])
    per_page, page = min(max(per_page, 1), MOST_PER_PAGE), max(page, 1)
    order = [F.col(column).desc_nulls_last() if falling else F.col(column).asc_nulls_first(), F.col(key)]
    total = narratives.count()
    rows = narratives.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return Page(rows, page, per_page, total, -(-total // per_page))


def roles_of(member: DataFrame, bridge: DataFrame, stories: DataFrame | None = None) -> DataFrame:
    """``(cluster_id, role_id)``: the roles of a narrative's articles (article_id, role_id), and those that name it as their story."""
    rows = member.select("cluster_id", "article_id").join(bridge.select("article_id", "role_id"), "article_id").select("cluster_id", "role_id")
    return (rows.unionByName(stories.select("cluster_id", "role_id")) if stories is not None else rows).distinct()


def role_stories(member: DataFrame, bridge: DataFrame, shown: DataFrame) -> DataFrame:
    """``(role_id, count, cluster_id)``: how many articles a role has, and the narrative of its first article where it is ``shown`` (cluster_id)."""
    per = bridge.groupBy("role_id").agg(F.count("*").alias("count"), F.min("article_id").alias("article_id"))
    own = member.select("article_id", "cluster_id").join(shown.select("cluster_id"), "cluster_id", "left_semi")
    return per.join(own, "article_id", "left").select("role_id", "count", "cluster_id")
