"""How much a run takes from its feeds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(rows: DataFrame, most: int, feed: str = "source_id", order: tuple[str | Column, ...] = ("article_id",)) -> DataFrame:
    """The rows that a run of at most ``most`` takes: of each feed the first so many in order, feed by feed until all are taken.

    A feed's share is ``most`` divided by the feeds, rounded down, one at least; feeds come in the order of their names,
    so where there are more feeds than rows to take, the last ones have none. Rows without a feed are left out. A feed's
    rows beyond its share are dropped before they are shuffled, and the limit sees no more than that.
    """
    known = rows.where(F.col(feed).isNotNull())
    feeds = known.select(feed).distinct().count()
    if not feeds or most <= 0:
        return rows.limit(0)
    place = F.row_number().over(Window.partitionBy(feed).orderBy(*order))
    share = known.withColumn("_place", place).where(F.col("_place") <= max(1, most // feeds))
    return share.orderBy(feed, "_place").limit(most).drop("_place")
