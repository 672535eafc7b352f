"""Text rules that several operators share, as DataFrame expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII texts take Spark's fast ``lower``, which maps the same letters there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))
