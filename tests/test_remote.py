"""Feeds and search pages as data sources, with files and functions in place of a network."""

import json
import time

import pytest
from pyspark.sql import functions as F

from newsloom.sources import feeds, remote
from newsloom.storage import fresh_path

FILES = "newsloom.sources.remote:from_files"
HERE = "tests.test_remote:pretend"
RSS = """<?xml version="1.0"?><rss xmlns:media="http://m" xmlns:dc="http://d" xmlns:content="http://c"><channel><title>A</title>
<item><title>One</title><link>http://a/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>sum</description><content:encoded>more</content:encoded>
<dc:creator>Ann</dc:creator><media:content url="http://a/1.jpg" medium="image"/></item>
<item><title>Late</title><link>http://a/2</link><pubDate>Mon, 01 Jan 2029 10:00:00 GMT</pubDate><description>x</description></item>
<item><title>Blank</title><link>http://a/3</link><description> </description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>B</title><entry><title>Two</title><link rel="self" href="http://no"/><link href="http://b/1"/>
<summary>s &amp; t</summary><content>c</content><author><name>Bob</name></author><published>2024-01-02T00:00:00Z</published></entry></feed>"""


def pretend(address: str, timeout: float) -> bytes:
    """A transport that knows three addresses; one fails at first."""
    if address.endswith("flaky"):
        mark = address.removeprefix("file:").removesuffix("flaky") + "tried"
        with open(mark, "a+", encoding="utf-8") as f:
            f.seek(0)
            tried = len(f.read())
            f.write("x")
        if tried < 2:
            raise TimeoutError("slow")
        return ATOM.encode()
    if "pageno=2" in address:
        raise OSError("gone")
    if address.startswith("http://search"):
        assert "q=a+b" in address and "format=json" in address and "language=de" in address
        page = int(address.rsplit("pageno=", 1)[1])
        return json.dumps({"results": [{"url": f"http://www.r.net/{page}/{i}", "title": f"t{page}{i}", "metadata": {"k": 1}} for i in range(3)]}).encode()
    raise OSError("no such host")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    return {"a": f"file://{tmp_path}/a.xml", "b": f"file://{tmp_path}/b.xml"}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_feed_gives_the_rows_of_its_file(spark, folder):
    fetched = remote.fetch_feeds(spark, folder, transport=FILES)
    assert fetched.rdd.getNumPartitions() == 2
    got = feeds.articles_of(fetched, before="2025-01-01")
    want = feeds.read_feed(spark, folder["a"], "a", before="2025-01-01").unionByName(feeds.read_feed(spark, folder["b"], "b", before="2025-01-01"))
    assert rows(got) == rows(want) and got.columns == list(feeds.ARTICLE)
    assert [(r[0], r[1], r[2], r[4]) for r in rows(got)] == [("a", "sum\n\nmore", "http://a/1", "Ann"), ("b", "s & t\n\nc", "http://b/1", "Bob")]


def test_failing_feeds_are_rows_with_an_error(spark, folder, tmp_path):
    feeds_of = folder | {"lost": f"file://{tmp_path}/none.xml", "odd": f"file://{tmp_path}/odd.xml"}
    (tmp_path / "odd.xml").write_text("not xml <<<")
    fetched = remote.fetch_feeds(spark, feeds_of, transport=FILES, retries="0")
    assert {r.source_id: r.error and r.error.split(":")[0] for r in fetched.collect()} == {"a": None, "b": None, "lost": "FileNotFoundError", "odd": None}
    assert {r[0] for r in rows(feeds.articles_of(fetched))} == {"a", "b"}
    with pytest.raises(Exception, match="FileNotFoundError|No such file"):
        remote.fetch_feeds(spark, feeds_of, transport=FILES, retries="0", strict="true").collect()
    assert remote.fetch_feeds(spark, {}, transport=FILES).count() == 0


def test_retries(spark, tmp_path):
    address = f"file:{tmp_path}/flaky"
    got = remote.fetch_feeds(spark, {"f": address}, transport=HERE, retries="2", wait="0.01").select("source_id", "error").collect()
    assert [tuple(r) for r in got] == [("f", None)]
    (tmp_path / "tried").write_text("")
    assert remote.fetch_feeds(spark, {"f": address}, transport=HERE, retries="1", wait="0.01").first().error == "TimeoutError: slow"


def test_a_stream_polls_and_goes_on_after_a_restart(spark, folder, tmp_path):
    path, checkpoint = fresh_path(spark, "polls"), fresh_path(spark, "polls-at")

    def poll():
        stream = feeds.articles_of(remote.fetch_feeds(spark, folder, stream=True, transport=FILES), before="2025-01-01")
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
        return spark.read.parquet(path)

    want = rows(feeds.articles_of(remote.fetch_feeds(spark, folder, transport=FILES), before="2025-01-01"))
    assert rows(poll()) == want
    (tmp_path / "b.xml").write_text(ATOM.replace("http://b/1", "http://b/2"))
    again = rows(poll())
    assert len(again) == 4 and {r[2] for r in again} == {"http://a/1", "http://b/1", "http://b/2"}


def test_a_stream_polls_again_and_again(spark, folder):
    got = []
    stream = remote.fetch_feeds(spark, folder, stream=True, transport=FILES)
    query = stream.writeStream.foreachBatch(lambda df, n: got.append(df.count())).option("checkpointLocation", fresh_path(spark, "at")).trigger(processingTime="200 milliseconds").start()
    until = time.time() + 60
    while len(got) < 3 and time.time() < until:
        time.sleep(0.1)
    query.stop()
    assert got[:3] == [2, 2, 2]


def test_search_pages_up_to_a_limit(spark):
    found = remote.search_web(spark, "http://search", "a b", 5, pages=3, transport=HERE, retries="0", language="de", time_range=None)
    assert [(r.title, r.url) for r in found.orderBy("n").collect()] == [("t10", "http://www.r.net/1/0"), ("t11", "http://www.r.net/1/1"), ("t12", "http://www.r.net/1/2"), ("t30", "http://www.r.net/3/0"), ("t31", "http://www.r.net/3/1")]
    assert feeds.search_articles(found).select("source_id").distinct().collect()[0][0] == "r.net"
    assert remote.search_web(spark, "http://nobody", "a", 5, transport=HERE, retries="0").count() == 0
    assert remote.search_web(spark, "http://search", "a b", 100, pages=3, transport=HERE, retries="0", language="de").where(F.col("metadata") == '{"k": 1}').count() == 6
