"""Tables in versions: every change is a new folder, and one renamed pointer file makes it the table.

A reader sees the version that the pointer names, whole. A writer that dies before the pointer moves has changed
nothing; its folder goes with the next ``vacuum``. One writer at a time is assumed, as for a plain folder.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import storage


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def _pointer(self) -> str:
        return f"{self.path}/_current"

    def version(self) -> str | None:
        """The name of the current version, or None before the first."""
        return storage.read_text(self.spark, self._pointer)

    def read(self) -> DataFrame:
        now = self.version()
        if now is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.parquet(f"{self.path}/{now}")

    def write(self, rows: DataFrame) -> str:
        """Write a version without making it the table."""
        name = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def publish(self, name: str) -> None:
        storage.replace_text(self.spark, self._pointer, name)

    def replace(self, rows: DataFrame) -> None:
        self.publish(self.write(rows))

    def upsert(self, rows: DataFrame, key: str, order: str) -> None:
        """Rows take the place of those with their key, others are added; of a key that comes twice the last in ``order`` counts.

        Of rows that tie there, one is taken by their contents, the same each time.
        """
        last = F.max_by(F.struct(*rows.columns), F.struct(order, F.xxhash64(*rows.columns)))
        new = rows.groupBy(key).agg(last.alias("r")).select("r.*")
        if self.version() is None:
            return self.replace(new)
        kept = self.read().join(new.select(key), key, "left_anti")
        return self.replace(kept.unionByName(new, allowMissingColumns=True))

    def delete(self, keys: DataFrame, key: str) -> None:
        self.replace(self.read().join(keys.select(key), key, "left_anti"))

    def compact(self, files: int) -> None:
        """The same rows in so many files."""
        self.replace(self.read().repartition(files))

    def vacuum(self) -> int:
        """Delete all versions but the current; how many went."""
        old = [p for p in storage.children(self.spark, self.path) if p.rsplit("/", 1)[-1].startswith("v-") and not p.endswith(f"/{self.version()}")]
        for p in old:
            storage.remove(self.spark, p)
        return len(old)


def rebuild(table: VersionedTable, rows: DataFrame, key: str) -> DataFrame:
    """Make ``rows`` the table and return the keys that only the old version had, written: what a reader must forget."""
    old = table.read().select(key) if table.version() else rows.select(key).limit(0)
    stale = storage.materialize(old.join(rows.select(key), key, "left_anti"), "stale", free=False)
    table.replace(rows)
    return stale
