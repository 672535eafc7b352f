"""Articles of feeds through the whole gate, with a budget for each run: the state of each feed is Spark's.

Of every feed the state has the addresses taken or turned away, the first fifty titles, and how many articles the run
has taken. An article passes if its address is new, its host is not blocked, its text has forty characters (a short one
is fetched again first, where a fetch is given), its title is not nearly one of the fifty, and the feed's share of the
run is not used up, in this order. What comes after the share is used up is not remembered: a later run may take it.

A feed's share is the run's articles divided by the feeds, one at least. Where there are more feeds than articles, runs
take turns: each run asks the next so many feeds in the order of their names. So no feed is shut out for good, the run
never takes more than its budget, and no state spans feeds.
"""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from newsloom.functions import text as T
from newsloom.functions.recover import ALIKE, TITLES, near
from newsloom.storage import discard, materialize
from newsloom.streaming.ingest import FEW, SHORT, cap
from newsloom.versioned import VersionedTable

#: Texts under so many characters are fetched again.
BRIEF = 200
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def turn(feeds: list[str], most: int, run: int) -> dict[str, int]:
    """How many articles each feed may give in a run; feeds without a turn are left out."""
    names = sorted(set(feeds))
    if not names or most <= 0:
        return {}
    asked = min(most, len(names))
    begin = run * asked % len(names)
    return {names[(begin + i) % len(names)]: most // asked for i in range(asked)}


class Gate(StatefulProcessor):
    """One feed's articles in order of ``at``, then address."""

    def __init__(self, shares: dict[str, int], run: int, fetch: Callable[[str], str | None] | None):
        self.shares, self.run, self.fetch = shares, run, fetch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "url string", "run long")
        self.titles = handle.getListState("titles", "title string")
        self.taken = handle.getValueState("taken", "run long, n long")

    def _text(self, row: Row) -> str:
        """The article's text, or the longer one that fetching gives; a fetch that fails changes nothing."""
        text = row.text or ""
        if self.fetch and 0 < len(text.strip()) < BRIEF:
            try:
                full = self.fetch(row.url) or ""
            except Exception:  # noqa: BLE001
                full = ""
            if len(full.strip()) > len(text.strip()):
                return full
        return text

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        share = self.shares.get(key[0], 0)
        state = self.taken.get()
        before = n = state[1] if state and state[0] == self.run else 0
        if n >= share:
            return
        known = [t[0] for t in self.titles.get()]
        more: list[tuple[str]] = []
        for row in sorted(rows, key=lambda r: (r.at is None, r.at or "", r.url)):
            if n >= share:
                break
            if self.seen.containsKey((row.url,)):
                continue
            self.seen.updateValue((row.url,), (self.run,))
            text = "" if row._blocked else self._text(row)
            title = (row.title or "").strip().lower()
            if len(text.strip()) < SHORT or (title and near(title, known)):
                continue
            if title and len(known) < TITLES:
                known.append(title)
                more.append((title,))
            n += 1
            out = row.asDict()
            out.pop("_blocked")
            yield Row(**(out | {"text": text}))
        if more:
            self.titles.appendList(more)
        if n > before:
            self.taken.update((self.run, n))

    def close(self) -> None:
        pass


def gated(rows: DataFrame, feeds: list[str], most: int, run: int, fetch: Callable[[str], str | None] | None = None) -> DataFrame:
    """The stream's rows (source_id, url, title, text, at, ...) that run ``run`` takes from ``feeds``, at most ``most``.

    ``at`` is text; rows without one come last. Rows without an address or of other feeds are left out, and feeds that
    have no turn are not shuffled. Addresses are kept for good, as in a
    crawl that never fetches twice. A trigger's rows of one feed are put in order in one task: ``maxFilesPerTrigger``
    bounds them. The titles are the first ``TITLES`` of
    a feed; a title is near one of them from a likeness of ``ALIKE`` on.
    """
    shares = turn(feeds, most, run)
    blocked = F.greatest(F.lit(False), *[F.coalesce(T.domain(F.col("url")).contains(d), F.lit(False)) for d in T.BLOCKED])
    asked = rows.where(F.col("url").isNotNull() & F.col("source_id").isin(*shares)).withColumn("_blocked", blocked)
    gate = Gate(shares, run, fetch)
    return asked.groupBy("source_id").transformWithState(gate, rows.schema, "Append", "None")


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which this kind of state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def follow_feeds(
    rows: DataFrame, target: VersionedTable, checkpoint: str, feeds: list[str], most: int, run: int, fetch: Callable[[str], str | None] | None = None,
    once: bool = True, interval: str = "60 seconds", on_new: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Start a run over a stream of articles that merges what passes ``gated`` into ``target``; ``once`` takes what is there and ends.

    Where ``target`` has almost no articles, the run may take two hundred. A run that is started again with its number
    goes on with what its budget has left; with the next number a new budget begins over the same state.
    """
    known = target.read().limit(FEW).count() if target.version() else 0
    taken = gated(rows, feeds, cap(known, most), run, fetch)

    def tick(batch: DataFrame, number: int) -> None:
        new = materialize(batch, "tick", free=False)  # whole and once: what reads a part would end the state's task early
        if not new.isEmpty():
            target.upsert(new, "url", "at")
            if on_new:
                on_new(new, number)
        discard(new)

    writer = taken.writeStream.outputMode("append").foreachBatch(tick).option("checkpointLocation", checkpoint)
    with _rocks(rows.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
