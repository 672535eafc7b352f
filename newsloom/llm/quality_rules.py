"""Quality rules by weak supervision: rules vote or abstain, and a posterior decides instead of all rules passing.

One pass over the texts gives the figures of each document, within the row and without a shuffle; the table of figures
is written, its vote patterns are counted, and the fitted posterior is an expression over the figures. The estimation
reads the rows that pass the base rules, which alone are in question: with the others in, the two labels that explain
the votes best are "short or repeated" and the rest.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import weak
from newsloom.llm.text import WORD, whole
from newsloom.storage import materialize

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


def _figures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Figures of whole texts. Windows of words are compared by 64-bit hashes within their own text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).cast("string").alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    hashes = F.expr(f"transform(sequence(1, CAST(n_words AS INT) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))")
    rows = rows.withColumn("hashes", F.when(F.col("n_words") >= WINDOW, hashes).otherwise(F.expr("array(0L)")))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.expr("sort_array(transform(hashes, (h, i) -> named_struct('h', h, 'i', i)))")
    rows = rows.withColumn("placed", F.when(repeats, placed))
    twice = F.expr("sort_array(transform(filter(placed, (x, k) -> get(placed, k - 1).h = x.h OR get(placed, k + 1).h = x.h), x -> x.i))")
    rows = rows.withColumn("twice", F.when(F.col("placed").isNotNull(), twice))
    covered = F.expr(f"aggregate(transform(twice, (p, k) -> least({WINDOW}, coalesce(get(twice, k + 1) - p, {WINDOW}))), 0L, (x, y) -> x + y)")
    return rows.select(
        "doc_id", "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("n_stops"),
        F.regexp_count("text", F.lit("!!")).cast("long").alias("n_shouts"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote over the figures: 1 for good, -1 for bad, 0 to abstain; on short texts most rules abstain."""
    c, n = F.col, F.col("n_words")
    some, chars = n >= 20, c("word_chars")
    mean = chars / F.greatest(n, F.lit(1))
    spread = F.log(F.greatest(c("n_distinct"), F.lit(2)).cast("double")) / F.log(F.greatest(n, F.lit(2)).cast("double"))
    return {
        "length": _vote(n >= 50, n < 20),
        "word_length": _vote(mean.between(4.4, 7), (mean < 3.5) | (mean > 9)),
        "stops": _vote(some & (c("n_stops") * 33 >= n) & (c("n_stops") * 4 <= n), some & (c("n_stops") * 100 < n)),
        "symbols": _vote(some & (c("n_symbols") == 0), c("n_symbols") * 10 > n),
        # Weak ones: good documents too have headings and refrains twice.
        "dup_lines": _vote((c("n_dup_lines") == 0) & (c("n_lines") >= 3), c("n_dup_lines") * 5 > c("n_lines")),
        "repeats": _vote(some & (c("n_repeat_words") == 0), c("n_repeat_words") * 20 > n),
        "upper": _vote(some & (c("n_upper") * 250 > chars) & (c("n_upper") * 10 <= chars), some & ((c("n_upper") * 500 <= chars) | (c("n_upper") * 4 > chars))),
        "variety": _vote(some & (spread >= 0.9), some & (spread < 0.75)),
        "shouts": _vote(F.lit(False), c("n_shouts") * 20 > n),
    }


def _failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def estimate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, weak.Votes]:
    """The figures and votes of every row, written; and what the rules' votes are worth (see ``Votes.reliabilities``)."""
    votes = rules()
    rows = materialize(_figures(docs, id_col, text_col).withColumns({f"v_{k}": v for k, v in votes.items()}), "figures")
    return rows, weak.fit(rows.where(~_failed()), [f"v_{k}" for k in votes])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality)`` of every row.

    A null text has no words, so it fails the base rules, as all texts under 20 words do; ``quality`` is the posterior
    all the same. Rows that repeat each vote and are each returned. No rows: an empty result.
    """
    rows, model = estimate(docs, id_col, text_col)
    quality = model.posterior([F.col(f"v_{k}") for k in rules()])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"),
        (~_failed() & (quality >= 0.5)).alias("kept"), quality.alias("quality"),
    )
