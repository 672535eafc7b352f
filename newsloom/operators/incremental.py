"""Narratives that grow with every batch of articles.

What is kept are ids: the roles of each article as digests, its narrative, and its date, source and title. Old texts are
never read again. A batch changes links in two ways. It brings articles that share roles with others; and it moves the
bounds of the frequency cut, so that a role may begin or cease to count. So the articles whose links can be new are those
of the batch, those with a role that begins to count, and those of a narrative in which a role ceases to count: such a
narrative is taken apart. All other narratives keep their links and are one node each. The components of this small graph
give the new narratives, which are those of a rebuild over all articles.

Each batch writes its own rows and the labels that it changes. One small file lists what counts; its renaming makes a
batch visible, whole, and a batch that comes again changes nothing. One writer at a time.
"""

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom import storage
from newsloom.operators import lineage
from newsloom.operators.graph import connected_components
from newsloom.operators.lineage import DF_LEAST, DF_SHARE, SMALL

KEPT = ("article_id", "source_id", "event_ts", "event_sec", "title")
KINDS = {"roles": "article_id long, key binary", "articles": "article_id long, source_id string, event_ts string, event_sec long, title string", "labels": "article_id long, cluster_id long"}
PLACE = "_batches"


def _counts(df: str, most: int) -> Column:
    """Whether a role with so many articles links them."""
    return F.col(df).between(2, most)


class Narratives:
    def __init__(self, spark: SparkSession, path: str):
        """Open what is kept in a folder; an empty one is a beginning."""
        self.spark, self.path = spark, path.rstrip("/")
        said = storage.read_text(spark, f"{self.path}/{PLACE}")
        self.state = json.loads(said) if said else {"n": 0, "batches": []}

    def _read(self, kind: str) -> DataFrame:
        """The rows of all batches, with the number of the batch."""
        parts = [self.spark.read.schema(KINDS[kind]).parquet(f"{self.path}/{b['name']}/{kind}").withColumn("batch", F.lit(i)) for i, b in enumerate(self.state["batches"])]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], KINDS[kind] + ", batch int")

    def labels(self) -> DataFrame:
        """``(article_id, cluster_id)``: each article's narrative, as the last batch that changed it left it."""
        return self._read("labels").groupBy("article_id").agg(F.max_by("cluster_id", "batch").alias("cluster_id"))

    def members(self) -> DataFrame:
        """As ``lineage.members``: narratives in order of time, a late article taking the place that its date gives it."""
        rows = self._read("articles").drop("batch").join(self.labels(), "article_id")
        order = Window.partitionBy("cluster_id").orderBy(F.col("event_sec").asc_nulls_last(), "article_id")
        return rows.withColumn("rn", F.row_number().over(order).cast("long"))

    def add(self, articles: DataFrame) -> DataFrame:
        """Take up articles (article_id, text, source_id, event_ts, event_sec, title); ``(article_id, was, cluster_id)`` of what changed.

        Articles that are known are left out, as are null ids; of an id that comes twice the first by date, then text,
        counts. ``was`` is null for new articles.
        """
        name = f"b-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        old = storage.materialize(self.labels(), "labels", free=False)
        once = articles.where("article_id IS NOT NULL").groupBy("article_id").agg(F.min_by(F.struct("text", *KEPT[1:]), F.struct("event_sec", "text")).alias("r")).select("article_id", "r.*")
        batch = storage.materialize(once.join(old.select("article_id"), "article_id", "left_anti"), "batch", free=False)
        n_new = batch.count()
        batch.select(*KEPT).write.parquet(f"{at}/articles")
        lineage.roles(batch.select("article_id", "text")).select("article_id", F.unhex(F.md5("norm")).alias("key")).write.parquet(f"{at}/roles")
        fresh = self.spark.read.schema(KINDS["roles"]).parquet(f"{at}/roles")
        changed = storage.materialize(self._changed(old, batch.select("article_id"), fresh, n_new), "changed", free=False)
        changed.select("article_id", "cluster_id").write.parquet(f"{at}/labels")
        self.state = {"n": self.state["n"] + n_new, "batches": [*self.state["batches"], {"name": name}]}
        storage.replace_text(self.spark, f"{self.path}/{PLACE}", json.dumps(self.state))
        storage.discard(old, batch)
        return changed

    def _changed(self, old: DataFrame, new: DataFrame, fresh: DataFrame, n_new: int) -> DataFrame:
        kept = self._read("roles").drop("batch")
        most_old, most = (max(DF_LEAST, int(DF_SHARE * n)) for n in (self.state["n"], self.state["n"] + n_new))
        both = kept.withColumn("is_new", F.lit(0)).unionByName(fresh.withColumn("is_new", F.lit(1)))
        df = both.groupBy("key").agg(F.sum(1 - F.col("is_new")).alias("df_old"), F.count("*").alias("df"))
        role = storage.materialize(df.select("key", _counts("df_old", most_old).alias("did"), _counts("df", most).alias("does")).where("did OR does"), "roles-that-count", free=False)
        rows = storage.materialize(both.join(role.where("does").select("key"), "key", "left_semi").select("article_id", "key"), "role-rows", free=False)

        # Narratives in which a role ceases to count are taken apart.
        ceased = kept.join(role.where("did AND NOT does"), "key", "left_semi").select("article_id").distinct()
        apart = storage.materialize(old.join(ceased, "article_id", "left_semi").select("cluster_id").distinct(), "apart", free=False)
        begins = role.where("does AND NOT did").select("key")
        loose = old.join(apart, "cluster_id", "left_semi").select("article_id")
        asked = rows.join(begins, "key", "left_semi").select("article_id").unionByName(loose).unionByName(new).distinct()
        node = old.join(apart.withColumn("gone", F.lit(True)), "cluster_id", "left").select("article_id", F.when(F.col("gone"), F.col("article_id")).otherwise(F.col("cluster_id")).alias("node"))
        node = storage.materialize(node.unionByName(new.select("article_id", F.col("article_id").alias("node"))), "nodes", free=False)

        links = self._links(rows, storage.materialize(asked, "asked", free=False))
        side = lambda s: node.select(F.col("article_id").alias(s), F.col("node").alias(f"node_{s}"))
        edges = links.join(side("a"), "a").join(side("b"), "b").where("node_a <> node_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        label = connected_components(edges, small=SMALL).select("node", "component")
        now = node.join(label, "node", "left").select("article_id", F.coalesce("component", "node").alias("cluster_id"))
        was = old.withColumnRenamed("cluster_id", "was")
        return now.join(was, "article_id", "left").where("was IS NULL OR was <> cluster_id").select("article_id", "was", "cluster_id")

    def _links(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """``(a, b)``: links that make the components of all pairs with shared roles of which one article is asked for.

        The roles of these articles, in all articles that have them, link as in a rebuild (``lineage.linked_by``). That
        links other articles by them too, which have been in one narrative before.
        """
        keys = rows.join(asked, "article_id", "left_semi").select("key").distinct()
        return lineage.linked_by(storage.materialize(rows.join(keys, "key", "left_semi").select("article_id", "key"), "linking-roles", free=False))

    def compact(self) -> None:
        """All batches as one; the folders of the old ones go with the next ``vacuum``."""
        if len(self.state["batches"]) > 1:
            name = f"b-{uuid.uuid4().hex}"
            for kind, rows in (("roles", self._read("roles").drop("batch")), ("articles", self._read("articles").drop("batch")), ("labels", self.labels())):
                rows.write.parquet(f"{self.path}/{name}/{kind}")
            self.state = self.state | {"batches": [{"name": name}]}
            storage.replace_text(self.spark, f"{self.path}/{PLACE}", json.dumps(self.state))

    def vacuum(self) -> int:
        """Delete the folders of batches that do not count; how many went."""
        known = {b["name"] for b in self.state["batches"]}
        old = [p for p in storage.children(self.spark, self.path) if (name := p.rsplit("/", 1)[-1]).startswith("b-") and name not in known]
        for p in old:
            storage.remove(self.spark, p)
        return len(old)


def follow(rows: DataFrame, path: str, checkpoint: str, once: bool = True, interval: str = "60 seconds"):
    """Start a stream of articles that feeds the narratives kept in ``path``; ``once`` takes what is there and ends."""

    def tick(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Narratives(batch.sparkSession, path).add(batch)

    writer = rows.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
