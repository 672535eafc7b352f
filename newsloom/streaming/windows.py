"""Counts over windows of event time; the same plan over a table and over a stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(rows: DataFrame, time_col: str, delay: str | None) -> DataFrame:
    return rows.withWatermark(time_col, delay) if delay and rows.isStreaming else rows


def counts(rows: DataFrame, time_col: str, by: list[str], length: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """``(start, *by, n)``: rows in tumbling windows, or sliding ones; in a stream rows later than ``delay`` are left out."""
    grouped = _late(rows, time_col, delay).groupBy(F.window(time_col, length, slide or length).alias("w"), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), *by, "n")


def sessions(rows: DataFrame, time_col: str, by: list[str], gap: str, delay: str | None = None) -> DataFrame:
    """``(start, end, *by, n)``: rows of a key with less than ``gap`` between neighbours; the end is the last row's time plus the gap.

    Spark's own windows also join rows that are a whole gap apart, so theirs is shorter by the last digit of a time.
    """
    grouped = _late(rows, time_col, delay).groupBy(F.session_window(time_col, f"{gap} -1 microseconds").alias("w"), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end"), *by, "n")
