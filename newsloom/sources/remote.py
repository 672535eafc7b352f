"""Feeds and search pages as Spark data sources: ``spark.read.format("newsloom-feeds")`` and ``"newsloom-search"``.

Each feed and each page of results is a partition of its own, so fetching is spread over the executors and a slow one
holds up nothing else. What fetches is a transport: a function from an address to bytes, named by ``module:function`` in
the option ``transport``. ``from_web`` is the default; ``from_files`` reads what Arrow's file systems reach, which is
how the tests and the catalogue run without a network.

The feed source gives documents as they are; ``feeds.articles_of`` makes articles of them with Spark's own XML reader.
As a stream a trigger is one poll of all feeds; entries come again with every poll, and what takes them up (``ingest``)
knows each address once.
"""

import importlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FEEDS, SEARCH = "newsloom-feeds", "newsloom-search"
FETCHED = "source_id string, address string, body string, error string"
RESULT = ("url", "title", "content", "publishedDate", "metadata", "img_src", "thumbnail", "image")
FOUND = "page int, n int, " + ", ".join(f"{c} string" for c in RESULT)
#: Fields of a search request besides ``q``, ``format`` and ``pageno``.
ASKED = ("categories", "language", "time_range")

Fetch = Callable[[str, float], bytes]


def from_web(address: str, timeout: float) -> bytes:
    request = urllib.request.Request(address, headers={"User-Agent": "newsloom"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.read()


def from_files(address: str, timeout: float) -> bytes:
    """A file, or the files of a folder in the order of their names; what follows ``?`` names a file in it by ``pageno``."""
    from pyarrow import fs

    where, _, asked = address.partition("?")
    page = urllib.parse.parse_qs(asked).get("pageno")
    system, path = fs.FileSystem.from_uri(f"{where}/pageno={page[0]}" if page else where)
    at = system.get_file_info(path)
    if at.type == fs.FileType.Directory:
        files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
    else:
        files = [path]
    return b"".join(system.open_input_stream(f).read() for f in sorted(files))


def _transport(options: dict[str, str]) -> Callable[[str], bytes]:
    """The fetch function of some options, with their ``timeout`` (seconds) and ``retries``, which wait ever longer."""
    module, _, name = options.get("transport", f"{__name__}:from_web").partition(":")
    fetch: Fetch = getattr(importlib.import_module(module), name)
    timeout, retries = float(options.get("timeout", 30)), int(options.get("retries", 2))

    def run(address: str) -> bytes:
        for attempt in range(retries + 1):
            try:
                return fetch(address, timeout)
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(min(2**attempt, 30) * float(options.get("wait", 1)))
        raise AssertionError

    return run


@dataclass
class Feed(InputPartition):
    source_id: str
    address: str


@dataclass
class ResultPage(InputPartition):
    page: int
    address: str


def _fetch_feed(options: dict[str, str], feed: Feed | None) -> Iterator[tuple]:
    """One row; a feed that cannot be had is a row with an error, and with ``strict`` fails the job.

    Where there are no partitions at all, Spark asks for one that is None.
    """
    if feed is None:
        return
    try:
        yield feed.source_id, feed.address, _transport(options)(feed.address).decode("utf-8", "replace"), None
    except Exception as e:
        if options.get("strict", "false").lower() == "true":
            raise
        yield feed.source_id, feed.address, None, f"{type(e).__name__}: {e}"


def _feeds(options: dict[str, str]) -> list[Feed]:
    return [Feed(source, address) for source, address in sorted(json.loads(options.get("feeds", "{}")).items())]


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return _feeds(self.options)

    def read(self, partition: Feed) -> Iterator[tuple]:
        return _fetch_feed(self.options, partition)


class _FeedStream(DataSourceStreamReader):
    """Offsets count polls: a poll is planned when the one before is done, and a poll that is repeated fetches again."""

    def __init__(self, options: dict[str, str]):
        self.options, self.poll = options, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.poll += 1
        return {"poll": self.poll}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.poll = max(self.poll, end["poll"])
        return _feeds(self.options) if end["poll"] > start["poll"] else []

    def read(self, partition: Feed) -> Iterator[tuple]:
        return _fetch_feed(self.options, partition)

    def commit(self, end: dict) -> None:
        self.poll = max(self.poll, end["poll"])


class FeedSource(DataSource):
    """Documents of feeds. Options: ``feeds`` (a JSON object of addresses by source), and those of the transport."""

    @classmethod
    def name(cls) -> str:
        return FEEDS

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _FeedStream(dict(self.options))


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        asked = {"q": self.options.get("q", ""), "format": "json"} | {k: self.options[k] for k in ASKED if self.options.get(k)}
        pages = range(1, int(self.options.get("pages", 1)) + 1)
        return [ResultPage(n, f"{self.options['endpoint']}?{urllib.parse.urlencode(asked | {'pageno': n})}") for n in pages]

    def read(self, partition: ResultPage) -> Iterator[tuple]:
        """The results of one page; none where it cannot be had or understood."""
        try:
            results = json.loads(_transport(self.options)(partition.address)).get("results") or []
            rows = [(partition.page, n, *[_text(r.get(c)) for c in RESULT]) for n, r in enumerate(results)]
        except Exception:
            if self.options.get("strict", "false").lower() == "true":
                raise
            rows = []
        return iter(rows)


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


class SearchSource(DataSource):
    """Results of a search. Options: ``endpoint``, ``q``, ``pages``, ``categories``, ``language``, ``time_range``."""

    @classmethod
    def name(cls) -> str:
        return SEARCH

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
    spark.dataSource.register(SearchSource)


def fetch_feeds(spark: SparkSession, feeds: dict[str, str], stream: bool = False, **options: str) -> DataFrame:
    """``(source_id, address, body, error)`` of each feed, as a table or as a stream of polls."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format(FEEDS)
    return reader.options(**options).option("feeds", json.dumps(feeds)).load()


def search_web(spark: SparkSession, endpoint: str, q: str, max_results: int, pages: int = 1, **options: str) -> DataFrame:
    """The first ``max_results`` results of so many pages, in order: ``n`` runs through all of them."""
    register(spark)
    asked = {k: v for k, v in options.items() if v is not None}
    rows = spark.read.format(SEARCH).options(**asked).option("endpoint", endpoint).option("q", q).option("pages", pages).load()
    first = rows.orderBy("page", "n").limit(max_results)
    return first.select((F.col("page") * F.lit(1 << 20) + F.col("n")).alias("n"), *RESULT)
