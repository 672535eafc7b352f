"""Exact deduplication against a persistent digest index.

The index is a folder of ``(digest, keep_id, group_size)``, bucketed and sorted by digest, that outlives the session. A
batch is reduced to one row per digest, joined against the index by a sort-merge anti-join that moves only the batch,
and appended. Texts never leave their scan task: 32-byte digests do.

Skew: copies of one text collapse to one row per scan task (partial aggregation) before the shuffle. The way back
from digest to documents is a join in which a copied text can hold any share of the rows: texts with at least one
thousandth of them, which are a thousand at most, travel by broadcast, and only the others by sort-merge join.
"""

import uuid
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.text import lower_ascii, whole
from newsloom.session import shuffle_width
from newsloom.storage import children, discard, fresh_path, materialize, read_text, remove, replace_text

#: At most so many groups can hold one row in HOT each.
HOT = 1000
#: A row's number, where doc_ids repeat.
ROW = "_newsloom_row"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)`` of every row; a null text counts as empty. The digest is SHA-256 of the text with A-Z lower."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(lower_ascii(whole(text_col)), 256)).alias("digest"))


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far, each with the batch that brought it.

    The index is its folder: where one is there, the table is registered over its files, with the number of buckets that
    they have, and nothing is written; else it is made, empty. ``append`` adds the digests of a batch that it lacks by a
    sort-merge anti-join. A batch that is appended again, as after a failure in the middle, finds its own digests and
    adds the rest.
    """

    SCHEMA = "digest binary, keep_id long, group_size long, batch string"
    #: The file that says how many buckets an index has; Spark's readers skip it.
    MARK = "_buckets"

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"newsloom_digests_{uuid.uuid4().hex}"
        self.path = (path or fresh_path(spark, "digests")).rstrip("/")
        there = read_text(spark, f"{self.path}/{self.MARK}")
        self.buckets = int(there) if there else buckets or shuffle_width(spark)
        if spark.catalog.tableExists(self.name):
            at = spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Location'").first()["data_type"]
            if PurePosixPath(urlsplit(at).path) != PurePosixPath(urlsplit(self.path).path):
                raise ValueError(f"{self.name} is an index in {at}")
            if there:
                return
            spark.sql(f"DROP TABLE {self.name}")  # its folder is gone
        if there is None and children(spark, self.path):
            raise ValueError(f"{self.path} is not empty and not an index")
        if there is None:
            replace_text(spark, f"{self.path}/{self.MARK}", str(self.buckets))
        spark.sql(
            f"CREATE TABLE {self.name} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _write(self, rows: DataFrame) -> None:
        out = rows.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).format("parquet")
        out.mode("append").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups (one row per digest) whose digest the index lacks: only the batch is shuffled."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        rows = self.unseen(groups).select("digest", F.col("keep_id").cast("long"), "group_size", F.lit(batch).alias("batch"))
        self._write(rows.repartition(self.buckets, "digest"))

    def drop(self) -> None:
        """Take the table out of the catalogue and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest doc_id (null only where all are null) and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def falling(rows: DataFrame, parts: int) -> list[DataFrame]:
    """The rows in so many ranges of doc_id, the largest first; null, the smallest, comes last."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if parts < 2 or low is None or not isinstance(low, int) or low == high:
        return [rows]
    cuts = sorted({low + (high - low) * k // parts for k in range(1, parts)} - {low}, reverse=True)
    ends = [*zip([None, *cuts], cuts, strict=False), (cuts[-1] if cuts else None, None)]
    below = lambda end: F.coalesce(F.col("doc_id") < end, F.lit(True)) if end is not None else F.lit(True)
    return [rows.where(below(end) & (F.col("doc_id") >= begin if begin is not None else F.lit(True))) for end, begin in ends]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None, parts: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The rows go through the index in batches of falling doc_id, each by the anti-join with what came before: so of equal
    texts the row with the largest doc_id stays. Texts that a given index has from earlier calls are all dropped and name
    the row kept then, whatever its doc_id; ``group_size`` counts the rows of the call in which a text was first seen. A
    batch of the same name as before is the same batch, so a second try gives the first one's answer. Without an index
    one is made, empty, and dropped once the result is written. Rows that repeat the kept doc_id with an equal text are
    one document given twice: each is returned, and each is marked kept. A null doc_id is smaller than any other. No
    rows: an empty result; other columns are not read.
    """
    spark, batch = docs.sparkSession, batch or uuid.uuid4().hex
    own = index or DigestIndex(spark)
    rows = materialize(digests(docs, id_col, text_col), "digest-rows")
    by_part = [materialize(group_digests(part), "digest-groups") for part in falling(rows, parts)]
    groups = by_part[0]
    if len(by_part) > 1:
        every = reduce(DataFrame.unionByName, by_part)
        groups = materialize(every.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "digest-groups")
    for part in by_part:
        # A text's size is that of the whole call, which the first part that has it puts into the index.
        own.append(part if part is groups else part.drop("group_size").join(groups.select("digest", "group_size"), "digest"), batch)
    known = own.read()
    hot = groups.where(F.col("group_size") >= F.lit(max(2, -(-rows.count() // HOT)))).select("digest")
    plain = rows.join(F.broadcast(hot), "digest", "left_anti").join(known.hint("merge"), "digest")
    both = plain.unionByName(rows.join(F.broadcast(known.join(F.broadcast(hot), "digest", "left_semi")), "digest"))
    out = both.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    if index is not None:
        return out
    out = materialize(out, "deduplicated")
    own.drop()
    discard(rows, groups, *by_part)
    return out


def numbered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame | None:
    """The rows with numbers of their own, written once so that they stay; None where no doc_id repeats."""
    if docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return None
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each text, the one with the largest doc_id, with its columns.

    Where doc_ids repeat they do not say which row is kept, so rows are numbered then; of rows that tie one stays.
    """
    rows = numbered(docs, id_col)
    if rows is not None:
        own = rows.select(F.col(id_col), ROW, F.unhex(F.sha2(lower_ascii(whole(text_col)), 256)).alias("digest"))
        last = own.groupBy("digest").agg(F.max(F.struct(id_col, ROW)).alias("last")).select(F.col("last")[ROW].alias(ROW))
        return rows.join(last, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    kept = deduplicate(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept_id"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
