"""A full-text index that can be changed: segments of postings, what later segments replace, and merges.

A segment is a folder of Parquet tables. Its postings - one row for each term, article and column - lie in buckets of
terms, sorted by term, so a query's terms are read from their buckets alone. Articles are dealt into blocks by their
id; a head says for each term and block how often an article has the term at most, and how long the shortest is.

An upsert is a segment with the new articles and the ids that it takes over; a delete one with ids alone. A posting
counts unless a later segment names its article. One small file lists the segments, and its renaming makes a change
visible, whole. One writer at a time.

The best results are found by block maxima: what any article of a block can score at most follows from the heads. The
most promising blocks are scored first, and only those that can still reach the last place after that.
"""

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import storage
from newsloom.functions.stem import stem, stems
from newsloom.operators.search import K1, LEAST_IDF, B, fold, parse
from newsloom.session import shuffle_width

#: Articles' fields that can be asked apart, in the order of the index.
COLUMNS = ("article_id", "title", "text", "author", "source_id", "published", "first_seen")
#: Characters of an article's text that are indexed where a limit is asked for.
TEXT_LIMIT = 3000
#: Blocks that are scored first.
FIRST = 8
PLACE = "_index"
#: The bucket of a segment's articles among its postings: rows without a term or a column.
DOCS = -1
#: So many replaced ids at most are sent to all tasks; more are joined by a shuffle.
FEW = 4_000_000


class Index:
    def __init__(self, spark: SparkSession, path: str):
        """Open an index; ``create`` makes one."""
        self.spark, self.path = spark, path.rstrip("/")
        said = storage.read_text(spark, f"{self.path}/{PLACE}")
        if said is None:
            raise FileNotFoundError(f"no index in {self.path}")
        self.state = json.loads(said)

    @classmethod
    def create(cls, spark: SparkSession, path: str, columns: tuple[str, ...] = ("title", "text"), buckets: int = 64, blocks: int = 256, text_limit: int | None = None, stemmed: bool = False) -> "Index":
        """An empty index. ``blocks`` should be a few thousandths of the articles; ``buckets`` bound what a term reads."""
        if storage.read_text(spark, f"{path}/{PLACE}") is not None:
            raise FileExistsError(f"an index is in {path}")
        state = {"columns": list(columns), "buckets": buckets, "blocks": blocks, "text_limit": text_limit, "stemmed": stemmed, "segments": [], "next": 0}
        storage.replace_text(spark, f"{path.rstrip('/')}/{PLACE}", json.dumps(state))
        return cls(spark, path)

    # Changes
    def upsert(self, articles: DataFrame, order: str = "published") -> None:
        """Take up articles in place of what the index has of their ids; of an id that comes twice the last in ``order``."""
        columns = list(dict.fromkeys(["article_id", "published", *self.state["columns"]]))
        rows = articles.select(*columns, F.col(order).alias("_order")) if order not in columns else articles.select(*columns).withColumn("_order", F.col(order))
        # Texts are dealt by block, and that is the only time that they move: postings are made and sorted where their text is.
        width = shuffle_width(self.spark)
        deal = F.pmod(F.xxhash64("article_id", F.lit(1)), F.lit(-(-width // self.state["blocks"])))
        dealt = rows.withColumns({"block": self._block(), "_deal": deal}).repartition(width, "block", "_deal")
        newest = dealt.groupBy("block", "_deal", "article_id").agg(F.max_by(F.struct(*columns), F.struct("_order", F.xxhash64(*columns))).alias("r")).select("block", "r.*")
        segment = f"s-{uuid.uuid4().hex}"
        fields = newest.select("block", "article_id", "published", self._words().alias("fields"))
        length = F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f["words"])).cast("long")
        article = F.struct(F.lit("").alias("term"), F.lit(-1).alias("col"), F.array().cast("array<int>").alias("at"), F.lit(False).alias("lead"))
        each = fields.select("block", "article_id", "published", length.alias("length"), F.explode(F.concat(F.array(article), self._own(F.col("fields")))).alias("p"))
        postings = each.select("p.term", "article_id", "p.col", "length", "published", "p.at", "p.lead", "block")
        placed = postings.withColumn("bucket", F.when(F.col("col") < 0, DOCS).otherwise(self._bucket(F.col("term"))))
        self._write(segment, placed, None, bool(self.state["segments"]))
        self._add(segment, posted=True, gone=bool(self.state["segments"]))

    def delete(self, ids: DataFrame) -> None:
        """Forget the articles of ``ids`` (article_id); unknown ones change nothing."""
        if self.state["segments"]:
            segment = f"s-{uuid.uuid4().hex}"
            ids.select("article_id").distinct().write.parquet(f"{self.path}/{segment}/gone")
            self._add(segment, posted=False, gone=True)

    def merge(self) -> None:
        """All segments as one, without what is gone. The folders of the old ones go with the next ``vacuum``."""
        if self.state["segments"]:
            segment = f"s-{uuid.uuid4().hex}"
            # A hot term's bucket is dealt by block too, so no task writes a term whole.
            live = self._live(self._postings()).drop("seq").repartition(shuffle_width(self.spark), "bucket", "block")
            self._write(segment, live, self.documents(), False)
            self.state["segments"] = []
            self._add(segment, posted=True, gone=False)

    def vacuum(self) -> int:
        """Delete the folders that no segment names; how many went."""
        known = {s["name"] for s in self.state["segments"]}
        old = [p for p in storage.children(self.spark, self.path) if (name := p.rsplit("/", 1)[-1]).startswith("s-") and name not in known]
        for p in old:
            storage.remove(self.spark, p)
        return len(old)

    def _words(self) -> Column:
        """The fields of an article with their words, each numbered from its own beginning."""
        fields = []
        for n, name in enumerate(self.state["columns"]):
            text = F.coalesce(F.col(name).cast("string"), F.lit(""))
            if name == "text" and self.state["text_limit"]:
                text = F.substring(text, 1, self.state["text_limit"])
            words = F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
            fields.append(F.struct(F.lit(n).alias("col"), (stems(words) if self.state["stemmed"] else words).alias("words")))
        return F.array(*fields)

    def _own(self, fields: Column) -> Column:
        """An article's postings: each of its terms in each column, with the places; ``lead`` marks the first column of a term."""
        bound = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # evaluated once, not for each element
        place = lambda f: F.transform(f["words"], lambda w, i: F.struct(w.alias("term"), f["col"].alias("col"), i.alias("at")))
        same = lambda s, i, c: F.get(s, i)[c] == F.get(s, i - 1)[c]
        begins = lambda s: F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | ~same(s, i, "term") | ~same(s, i, "col"))

        def run(s: Column, begin: Column) -> Column:
            end = lambda i, j: F.coalesce(F.get(begin, j + 1), F.size(s)) - i
            at = lambda i, j: F.transform(F.slice(s, i + 1, end(i, j)), lambda x: x["at"])
            lead = lambda i: (i == 0) | ~same(s, i, "term")
            return F.transform(begin, lambda i, j: F.struct(F.get(s, i)["term"].alias("term"), F.get(s, i)["col"].alias("col"), at(i, j).alias("at"), lead(i).alias("lead")))

        return bound(F.sort_array(F.flatten(F.transform(fields, place))), lambda s: bound(begins(s), lambda begin: run(s, begin)))

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("article_id"), F.lit(self.state["blocks"])).cast("int")

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.state["buckets"])).cast("int")

    def _write(self, segment: str, postings: DataFrame, docs: DataFrame | None, gone: bool) -> None:
        """Postings as they are dealt; without ``docs`` the articles are the rows of the bucket ``DOCS``."""
        at = f"{self.path}/{segment}"
        with storage.shuffles_cleaned(self.spark):
            postings.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{at}/postings")
            written = any("bucket=" in p for p in storage.children(self.spark, f"{at}/postings"))
            held = self.spark.read.parquet(f"{at}/postings") if written else postings
            # ``most`` bounds an article's occurrences by those of each column, so heads need no row for each article.
            most = [F.coalesce(F.max(F.when(F.col("col") == n, F.size("at"))), F.lit(0)) for n in range(len(self.state["columns"]))]
            heads = held.where(F.col("bucket") != DOCS).groupBy("bucket", "term", "block").agg(
                F.count_if("lead").alias("n"), reduce(lambda x, y: x + y, most).cast("long").alias("most"), F.min("length").alias("least"))
            heads.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{at}/heads")
            (held.where(F.col("bucket") == DOCS).select("article_id", "published", "length") if docs is None else docs).write.parquet(f"{at}/docs")
            if gone:
                self.spark.read.parquet(f"{at}/docs").select("article_id").write.parquet(f"{at}/gone")

    def _add(self, name: str, posted: bool, gone: bool) -> None:
        """Make a segment part of the index, with the number of live articles and of their words after it."""
        state = self.state | {"segments": [*self.state["segments"], {"name": name, "seq": self.state["next"], "posted": posted, "gone": gone}], "next": self.state["next"] + 1}
        self.state = state
        n, words = self.documents().agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        self.state |= {"articles": n, "words": words}
        storage.replace_text(self.spark, f"{self.path}/{PLACE}", json.dumps(self.state))

    # Reading
    def _table(self, kind: str) -> DataFrame | None:
        """One table of all segments, with ``seq``; those of no rows have no files and are left out."""
        parts = []
        for s in self.state["segments"]:
            at = f"{self.path}/{s['name']}/{kind}"
            if s["gone" if kind == "gone" else "posted"] and any("=" in p or p.endswith(".parquet") for p in storage.children(self.spark, at)):
                rows = self.spark.read.parquet(at).withColumn("seq", F.lit(s["seq"]))
                parts.append(rows.where(F.col("bucket") != DOCS) if kind == "postings" else rows)
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _live(self, rows: DataFrame | None) -> DataFrame | None:
        """Rows (article_id, seq) of which no later segment names the article."""
        gone = self._table("gone")
        if rows is None or gone is None:
            return rows
        last = gone.groupBy(F.col("article_id").alias("_gone_id")).agg(F.max("seq").alias("_gone"))
        if gone.count() <= FEW:  # a count of file footers
            last = F.broadcast(last)
        return rows.join(last, rows["article_id"] == last["_gone_id"], "left").where("_gone IS NULL OR _gone <= seq").drop("_gone_id", "_gone")

    def documents(self) -> DataFrame:
        """``(article_id, published, length)`` of the articles that the index has."""
        rows = self._live(self._table("docs"))
        return rows.drop("seq") if rows is not None else self.spark.createDataFrame([], "article_id long, published string, length long")

    def _postings(self, terms: list[str] | None = None, kind: str = "postings") -> DataFrame | None:
        rows = self._table(kind)
        if rows is None or terms is None:
            return rows
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term"))).distinct().collect()]
        return rows.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))

    def postings(self) -> DataFrame:
        """``(term, article_id, col, at, length, published)``: everything that the index holds."""
        return self._live(self._postings()).drop("seq", "block", "bucket", "lead")

    def phrases(self, query: str) -> list[tuple[str, ...]]:
        return list(dict.fromkeys(tuple(map(stem, p)) if self.state["stemmed"] else tuple(p) for p in parse(query)))

    def _matches(self, asked: list[tuple[str, ...]], columns: tuple[str, ...] | None, units: DataFrame | None = None) -> DataFrame | None:
        """``(article_id, phrase, tf, length, published)`` of the articles that hold a phrase, in some units alone if given."""
        rows = self._postings(sorted({t for p in asked for t in p}))
        if rows is None:
            return None
        if columns:
            rows = rows.where(F.col("col").isin(*[self.state["columns"].index(c) for c in columns]))
        if units is not None:
            rows = rows.join(F.broadcast(units.select("seq", "block")), ["seq", "block"], "left_semi")
        rows = self._live(rows)
        own = rows.groupBy("article_id", "col").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("at"), F.first("length").alias("length"), F.first("published").alias("published"))
        none = F.array().cast("array<int>")

        def begin(i: int, term: str) -> Column:
            return F.transform(F.coalesce(F.col("at")[term], none), lambda x: x - i)

        def begins(phrase: tuple[str, ...]) -> Column:
            return F.size(reduce(F.array_intersect, [begin(i, t) for i, t in enumerate(phrase)]))

        each = F.explode(F.array(*[F.struct(F.lit(i).alias("phrase"), begins(p).alias("tf")) for i, p in enumerate(asked)]))
        found = own.select("article_id", "length", "published", each.alias("f")).select("article_id", "length", "published", "f.phrase", "f.tf").where("tf > 0")
        return found.groupBy("article_id", "phrase").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"), F.first("published").alias("published"))

    def _weights(self, asked: list[tuple[str, ...]], columns: tuple[str, ...] | None) -> list[float]:
        """The weight of each phrase; heads alone say it where nothing is gone and all columns and single words are asked."""
        heads = self._postings(sorted({t for p in asked for t in p}), "heads")
        if heads is None:
            return [LEAST_IDF] * len(asked)
        if not columns and not any(s["gone"] for s in self.state["segments"]) and all(len(p) == 1 for p in asked):
            found = {(r.term,): r.n for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}
            df = [found.get(p, 0) for p in asked]
        else:
            found = {r.phrase: r.n for r in self._matches(asked, columns).groupBy("phrase").agg(F.count("*").alias("n")).collect()}
            df = [found.get(i, 0) for i in range(len(asked))]
        row = self.spark.range(1).select(*[F.log((F.lit(float(self.state["articles"])) - n + 0.5) / (F.lit(float(n)) + 0.5)).alias(f"w{i}") for i, n in enumerate(df)]).first()
        return [w if w > 0 else LEAST_IDF for w in row]

    def _part(self, weight: float | Column, tf: Column, length: Column) -> Column:
        mean = self.state["words"] / max(1, self.state["articles"])
        return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))

    def units(self, asked: list[tuple[str, ...]], weights: list[float]) -> DataFrame | None:
        """``(seq, block, most)``: the blocks that hold a phrase's terms, with what an article there can score at most."""
        heads = self._postings(sorted({t for p in asked for t in p}), "heads")
        if heads is None:
            return None
        by = heads.groupBy("seq", "block").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("most", "least")))).alias("h"))

        def bound(phrase: tuple[str, ...], weight: float) -> Column:
            tf = reduce(lambda x, y: F.least(x, y), [F.coalesce(F.col("h")[t]["most"], F.lit(0)) for t in phrase] + [F.lit(1 << 40)])
            length = reduce(lambda x, y: F.greatest(x, y), [F.coalesce(F.col("h")[t]["least"], F.lit(0)) for t in phrase] + [F.lit(0)])
            return F.when(tf > 0, self._part(weight, tf.cast("double"), length)).otherwise(0.0)

        # ``least`` and ``greatest`` skip no term: one that a block lacks has no occurrence there.
        most = reduce(lambda x, y: x + y, [bound(p, w) for p, w in zip(asked, weights, strict=True)])
        return by.select("seq", "block", most.alias("most")).where("most > 0")

    def search(self, query: str, k: int = 20, columns: tuple[str, ...] | None = None, first: int = FIRST) -> DataFrame:
        """``(article_id, score, published)``: the best ``k``, the lower the better, ties by article_id.

        Scores are those of ``search.scores``. With ``columns`` phrases are looked for there alone; an article's length
        is that of all its columns. ``self.scored`` says how many blocks of how many were scored.
        """
        asked = self.phrases(query)
        self.scored = (0, 0)
        empty = self.documents().limit(0).select("article_id", F.lit(0.0).alias("score"), "published")
        weights = self._weights(asked, columns) if asked and self.state.get("words") else []
        units = self.units(asked, weights) if weights else None
        if units is None:
            return empty
        units = storage.materialize(units, "index-units", free=False)
        total = units.count()
        weight = F.array(*[F.lit(w) for w in weights])

        def scored(of: DataFrame | None) -> DataFrame:
            found = self._matches(asked, columns, of)
            part = self._part(F.get(weight, F.col("phrase")), F.col("tf").cast("double"), F.col("length"))
            return found.groupBy("article_id").agg(F.round(-F.sum(part), 6).alias("score"), F.first("published").alias("published"))

        best = scored(units.orderBy(F.desc("most"), "seq", "block").limit(first)).orderBy("score", "article_id").limit(k).collect() if total > first else []
        rest = units
        if len(best) == k:
            rest = units.where(F.col("most") >= -best[-1].score - 2e-6)  # rounded scores tie
        self.scored = (rest.count(), total)
        return scored(rest if self.scored[0] < total else None).orderBy("score", "article_id").limit(k)


def hydrate(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """Hits with their articles' columns, best first; hits whose article is missing are dropped."""
    more = articles.drop("published") if "published" in articles.columns else articles
    return hits.join(more, "article_id").orderBy("score", "article_id")
