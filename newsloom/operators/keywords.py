"""Phrases of titles, for queries that look for more of the same."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that make no phrase, pieces of addresses, and what is asked for where there are no phrases.
STOP_WORDS = tuple(
    """the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could
    should may might must can this that these those it its their they them he she we you i said says according report reports
    reported news new today week month year time times day days month months year years one two three four five six seven eight
    nine ten first last next previous new old big small large great good bad high low long short early late right left up down
    out in over under again also just now then than more most some any all each every other another such only even still already
    ever never always often sometimes usually breaking update more latest current""".split()
)
URL_PIECES = tuple("https http www com org net html php asp aspx jsp cgi xml json api svc ftp ssh gov edu uk jp de fr au ca br in cn".split())
FALLBACK = ("breaking news", "world news today", "technology news", "business markets", "politics government")


def phrases(titles: DataFrame, most: int, column: str = "title") -> DataFrame:
    """``(gram, n)``: runs of two and three words of the titles, the most frequent first (ties by text).

    Words are three letters or more, A-Z in any case; stop words and pieces of addresses are taken out before runs are
    formed. Where there is no run at all, fixed phrases come back with a count of 0.
    """
    words = F.regexp_extract_all(F.lower(column), F.lit("[a-z]{3,}"), F.lit(0))
    rows = titles.select(F.filter(words, lambda w: ~w.isin(*STOP_WORDS, *URL_PIECES)).alias("w"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " ")))
    none = F.array().cast("array<string>")
    grams = rows.select(F.explode(F.concat(F.coalesce(runs(2), none), F.coalesce(runs(3), none))).alias("gram"))
    found = grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(most)
    spare = titles.sparkSession.createDataFrame([(g, 0) for g in FALLBACK], "gram string, n long").limit(most)
    return found.unionByName(spare.join(found.select(F.lit(1).alias("x")).limit(1), F.lit(True), "left_anti"))
