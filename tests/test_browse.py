"""Lists of narratives against plain code."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.operators import browse

DATES = [None, "", "not a date", "2024-03-31T00:00:00Z", "2024-03-30T23:59:59+00:00", "2024-03-30", "2024-03-24 15:30:00", "2024-03-24T15:29:59Z", "2024-03-01T15:30:00Z", "2023-04-01T00:00:00Z", "2024-03-31T01:00:00+02:00", "2030-01-01"]
NOW = "2024-03-31 15:30:00"


def plain(name, date):
    try:
        at = datetime.fromisoformat(date.replace("Z", "+00:00"))
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    except (ValueError, AttributeError):
        return True
    now = datetime(2024, 3, 31, 15, 30, tzinfo=timezone.utc)
    day = now.replace(hour=0, minute=0)
    back = {"last_week": 7, "last_month": 30, "last_year": 365}
    if name == "today":
        return at >= day
    if name == "yesterday":
        return day - timedelta(days=1) <= at < day
    return at >= now - timedelta(days=back[name]) if name in back else True


@pytest.mark.parametrize("name", ["today", "yesterday", "last_week", "last_month", "last_year", "all", "odd"])
def test_ranges_keep_what_they_do_not_understand(spark, name):
    rows = spark.createDataFrame(list(enumerate(DATES)), "i int, d string")
    got = {r.i for r in rows.where(browse.in_range(name, F.col("d"), NOW)).collect()}
    assert got == {i for i, d in enumerate(DATES) if plain(name, d)}


def test_cutoffs_follow_the_calendar(spark):
    at = lambda name, now: str(spark.range(1).select(browse.cutoff(name, now).cast("string")).first()[0])
    assert at("last_month", NOW) == "2024-03-02 00:00:00" and at("last_month", "2024-05-15 10:00:00") == "2024-04-15 00:00:00"
    assert at("last_year", "2024-02-29 10:00:00") == "2023-03-01 00:00:00" and at("last_week", NOW) == "2024-03-24 15:30:00"
    assert at("today", NOW) == "2024-03-31 00:00:00" and at("yesterday", NOW) == "2024-03-30 00:00:00" and browse.cutoff("", NOW) is None


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "2024-01-01", None, "2024-03-31 10:00:00", 2, "cnn,reuters"), (2, None, "2024-03-01", None, 1, "blog"), (3, "2024-03-01", "2024-03-02", "2024-03-30 01:00:00", 3, "bbc,cnn,npr"), (4, "2024-01-01", "2024-03-02", "2024-01-01", 1, "npr_rss")]
    return spark.createDataFrame(data, "cluster_id long, first_seen string, last_updated string, latest string, n_sources long, sources string")


def test_orders_and_clamps(spark, rows):
    ids = lambda sort, page=1, per=20, **o: [r.cluster_id for r in browse.page_of(rows, sort, page, per, **o).rows.orderBy("place").collect()]
    assert ids("newest") == [3, 1, 4, 2] and ids("oldest") == [2, 1, 4, 3] and ids("updated") == [3, 4, 2, 1] and ids("sources") == [3, 1, 2, 4]
    assert ids("latest") == ids("whatever") == [1, 3, 4, 2] and ids("newest", 2, 3) == [2] and ids("newest", 0, 0) == [3] and ids("newest", 9) == []
    page = browse.page_of(rows, per_page=1000, page=-3)
    assert (page.page, page.per_page, page.total, page.total_pages) == (1, 100, 4, 1)
    assert browse.page_of(rows.limit(0)).total_pages == 0
    assert ids("sources-asc", orders=browse.SCREEN_ORDERS) == [2, 4, 1, 3]


def test_screens(spark, rows):
    ids = lambda **o: sorted(r.cluster_id for r in browse.screen(rows, NOW, **o).collect())
    assert ids() == [1, 2, 3, 4] and ids(min_sources=2) == [1, 3] and ids(since="today") == [1] and ids(since="yesterday") == [1, 3]
    assert ids(source="npr") == [3, 4] and ids(source="n,") == [] and ids(source="NPR") == [] and ids(since="last_year", source="npr") == [3, 4]


def test_roles_by_articles_and_by_story(spark):
    member = spark.createDataFrame([(1, 11), (1, 12), (2, 21)], "cluster_id long, article_id long")
    bridge = spark.createDataFrame([(11, "a"), (12, "a"), (21, "b"), (99, "z")], "article_id long, role_id string")
    stories = spark.createDataFrame([(1, "c"), (2, "b")], "cluster_id long, role_id string")
    assert sorted(map(tuple, browse.roles_of(member, bridge, stories).collect())) == [(1, "a"), (1, "c"), (2, "b")]
    assert sorted(map(tuple, browse.roles_of(member, bridge).collect())) == [(1, "a"), (2, "b")]
    got = browse.role_stories(member, bridge, member.where("cluster_id = 1").select("cluster_id"))
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 2, 1), ("b", 1, None), ("z", 1, None)]
