"""Full-text search: an index of terms with places, BM25 over the terms that a query asks for, and pages of results."""

import math
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.stem import stem, stems
from newsloom.storage import materialize

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Latin letters with one mark and the plain ones that stand for them; those with two marks stay.
_FOLDED = {c: d[0] for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c == c.lower() and len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii() and d[0].isalpha()}
MARKED, PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())


def fold(text: Column) -> Column:
    """Lower case without the marks on Latin letters."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def terms(text: str) -> list[str]:
    folded = text.lower().translate(str.maketrans(MARKED, PLAIN))
    return re.findall(r"[^\W_]+", folded)


def parse(query: str) -> list[list[str]]:
    """The phrases that a query asks for, any of which is enough: words of two characters or more, each a phrase of its terms."""
    words = [w for w in query.split() if len(w) > 1] or [query]
    return [p for p in dict.fromkeys(tuple(terms(w)) for w in words) if p]


def entries(articles: DataFrame, columns: tuple[str, ...] = ("title", "text"), text_limit: int | None = None, stemmed: bool = False) -> DataFrame:
    """``(article_id, published, length, words)``: one row an article, its newest, with its words in order.

    ``published`` orders the rows of one article. Whole texts are indexed unless ``text_limit`` (characters) is given.
    Words of all columns share one numbering, with a gap between columns. A ``stemmed`` index holds their stems; queries
    of it must say so too.
    """
    newest = articles.groupBy("article_id").agg(F.max_by(F.struct(*articles.columns), "published").alias("r")).select("r.*")
    given = {c: F.coalesce(F.col(c), F.lit("")) for c in columns}
    if text_limit:
        given["text"] = F.substring(given["text"], 1, text_limit)
    body = F.concat_ws(" \u0001 ", *[fold(F.translate(x, "\u0001", " ")) for x in given.values()])
    words = F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}]+|\x01"), F.lit(0))
    rows = newest.select("article_id", "published", (stems(words) if stemmed else words).alias("words"))
    length = (F.size("words") - F.size(F.filter("words", lambda w: w == "\u0001"))).cast("long")
    return rows.select("article_id", "published", length.alias("length"), "words")


def postings_of(rows: DataFrame) -> DataFrame:
    """``(article_id, published, length, term, at)``: a row for each word and place of ``entries``."""
    return rows.select("article_id", "published", "length", F.posexplode("words").alias("at", "term")).where("term <> '\u0001'")


def index(articles: DataFrame, columns: tuple[str, ...] = ("title", "text"), text_limit: int | None = None, stemmed: bool = False) -> DataFrame:
    """The postings of the articles' ``entries``, as one lazy plan."""
    return postings_of(entries(articles, columns, text_limit, stemmed))


def stored(articles: DataFrame, columns: tuple[str, ...] = ("title", "text"), text_limit: int | None = None, stemmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Postings and the articles that have a word, both read from ``entries`` written once: texts are cut into words once."""
    rows = materialize(entries(articles, columns, text_limit, stemmed), "fts", free=False)
    return postings_of(rows), rows.where("length > 0").select("article_id", "published", "length")


def in_range(name: str, published: Column, today: str) -> Column:
    """Whether a date text (``yyyy-mm-dd...``) lies in a named range before ``today``; an unknown name means all."""
    day = F.to_date(F.lit(today))
    ago = {"today": 0, "yesterday": 1, "last_week": 7, "last_month": 30, "last_year": 365}
    if name not in ago:
        return F.lit(True)
    since = published >= F.date_sub(day, ago[name]).cast("string")
    return since & (published < F.lit(today)) if name == "yesterday" else since


@dataclass
class Page:
    hits: DataFrame
    total: int
    page: int
    total_pages: int


def scores(postings: DataFrame, documents: DataFrame, query: str, stemmed: bool = False) -> DataFrame:
    """``(article_id, score)`` of the articles that hold any phrase; the lower the better, as in SQLite's FTS5.

    Only the postings of the query's terms are read. ``documents`` is (article_id, length), one row an article.
    """
    asked = list(dict.fromkeys(tuple(map(stem, p)) if stemmed else p for p in parse(query)))
    size = documents.agg(F.count("*").cast("double").alias("n_all"), F.avg("length").alias("mean"))
    wanted = sorted({t for p in asked for t in p})
    rows = postings.where(F.col("term").isin(*wanted) if wanted else F.lit(False)).select("article_id", "term", "at")
    per = rows.groupBy("article_id", "term").agg(F.collect_set("at").alias("at"))
    places = per.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("at"))
    empty = F.array().cast("array<int>")

    def frequency(phrase: tuple[str, ...]) -> Column:
        begins = lambda i, t: F.transform(F.coalesce(F.col("at")[t], empty), lambda x: x - i)
        at = [begins(i, t) for i, t in enumerate(phrase)]
        met = at[0]
        for other in at[1:]:
            met = F.array_intersect(met, other)
        return F.size(met).cast("double")

    each = F.explode(F.array(*[F.struct(F.lit(i).alias("phrase"), frequency(p).alias("tf")) for i, p in enumerate(asked)])) if asked else F.explode(F.expr("CAST(array() AS array<struct<phrase:int,tf:double>>)"))
    found = places.select("article_id", each.alias("f")).select("article_id", "f.phrase", "f.tf").where("tf > 0")
    df = found.groupBy("phrase").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))
    raw = F.log((F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.select("phrase", "mean", F.when(raw > 0, raw).otherwise(LEAST_IDF).alias("idf"))
    rows = found.join(F.broadcast(idf), "phrase").join(documents, "article_id")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("article_id").agg(F.round(-F.sum(part), 6).alias("score"))


def search(postings: DataFrame, documents: DataFrame, query: str = "", range_name: str = "all", page: int = 1, limit: int = 20, today: str = "", stemmed: bool = False) -> Page:
    """One page: by rank where there is a query, else by date; ``documents`` is (article_id, published, length)."""
    own = documents.where(in_range(range_name, F.col("published"), today))
    if query.strip():
        ranked = own.join(scores(postings, documents.select("article_id", "length"), query, stemmed), "article_id").select("article_id", "published", "score")
        order = [F.col("score"), F.col("article_id")]
    else:
        ranked = own.select("article_id", "published", F.lit(None).cast("double").alias("score"))
        order = [F.col("published").desc_nulls_last(), F.col("article_id")]
    total = ranked.count()
    hits = ranked.orderBy(*order).offset((page - 1) * limit).limit(limit)
    return Page(hits, total, page, max(1, math.ceil(total / limit)) if total else 0)


def catalogue(postings: DataFrame) -> DataFrame:
    """``(article_id, published, length)`` of the articles in an index that have a word."""
    return postings.select("article_id", "published", "length").distinct()
