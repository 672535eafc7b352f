"""Tables of rows by key, in buckets of keys: a change rewrites the buckets of its own keys alone.

The bucket is a partition column, and a change is Spark's overwrite of the partitions that it writes. Unlike
``VersionedTable`` a reader may see some buckets before and some after a change; a change that ended in the middle is
finished by doing it again. One writer at a time.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import storage

BUCKET = "_bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), tuple(key), buckets

    def _stored(self) -> DataFrame | None:
        there = any(f"/{BUCKET}=" in p for p in storage.children(self.spark, self.path))
        return self.spark.read.parquet(self.path) if there else None

    def read(self) -> DataFrame:
        rows = self._stored()
        if rows is None:
            raise FileNotFoundError(f"no rows in {self.path}")
        return rows.drop(BUCKET)

    def upsert(self, rows: DataFrame, order: str) -> None:
        """Rows take the place of those with their key, others are added; of a key that comes twice the last in ``order``.

        Of rows that tie there, one is taken by their contents, the same each time. Rows with a null in the key are left out.
        """
        last = F.max_by(F.struct(*rows.columns), F.struct(order, F.xxhash64(*rows.columns)))
        self._change(rows.dropna(subset=list(self.key)).groupBy(*self.key).agg(last.alias("r")).select("r.*"), True)

    def delete(self, keys: DataFrame) -> None:
        """Rows with these keys go; unknown keys change nothing."""
        self._change(keys.select(*self.key).dropna().distinct(), False)

    def _change(self, rows: DataFrame, stay: bool) -> None:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        new = storage.materialize(rows.withColumn(BUCKET, bucket), "change", free=False)
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # a number for each bucket at most
        stored = self._stored()
        if not touched or (stored is None and not stay):
            return
        out = new
        if stored is not None:
            kept = stored.where(F.col(BUCKET).isin(*touched)).join(new.select(*self.key), list(self.key), "left_anti")
            out = kept.unionByName(new, allowMissingColumns=True) if stay else kept
        # An upsert leaves no bucket empty, and Spark puts the new files in place once all of them are written: nothing is written aside.
        aside = None if stay else storage.materialize(out, "buckets", free=False)
        with storage.shuffles_cleaned(self.spark):
            (out if aside is None else aside).repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        if aside is not None:
            for empty in {*touched} - {r[0] for r in aside.select(BUCKET).distinct().collect()}:
                storage.remove(self.spark, f"{self.path}/{BUCKET}={empty}")
        storage.discard(new, aside)


def role_references(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The references of roles, a row for each role and article: what a role has is known however often it comes."""
    return KeyedTable(spark, path, ("role_id", "article_id"), buckets)


def role_dimension(references: DataFrame) -> DataFrame:
    """``(role_id, norm, first_article_id, reference_count)`` of references (role_id, article_id, norm)."""
    return references.groupBy("role_id").agg(F.min_by("norm", "article_id").alias("norm"), F.min("article_id").alias("first_article_id"), F.count("*").alias("reference_count"))
