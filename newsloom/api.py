"""The engine as one object over a folder of tables: what a server or a shell calls."""

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import boundary, context, intersection, lineage, search, trust
from newsloom.storage import fresh_path, read_text, replace_text, state, table
from newsloom.versioned import VersionedTable, rebuild

FRAME = 0.85
#: The file that names the versions of the last run.
RUN = "_run"


@dataclass
class Report:
    """What a run of the pipeline did; frames are written tables."""

    lineage: DataFrame
    stale: DataFrame
    links: DataFrame
    pending: DataFrame
    brief: DataFrame
    trust: DataFrame


class News:
    """Articles, narratives and trust of the tables under ``sf_dir``; ``base_trust`` (source_id, trust) is given."""

    def __init__(self, spark: SparkSession, sf_dir: str, base_trust: DataFrame, now_sec: int, store: str | None = None):
        self.spark, self.sf_dir, self.base, self.now = spark, sf_dir, base_trust, now_sec
        self.articles = lineage.articles(spark, sf_dir)
        self.roles = lineage.stored_roles(spark, sf_dir)
        self._index: tuple | None = None
        self.store = store or fresh_path(spark, "store")

    @property
    def member(self) -> DataFrame:
        return lineage.members(self.spark, self.sf_dir)

    def vectors(self) -> DataFrame:
        """``(article_id, x)``: the articles that have a boundary vector."""
        return table(self.spark, self.sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("x"))

    def trusts(self) -> DataFrame:
        """``(source_id, trust)``: adjusted trust."""
        return self.update_trust().select("source_id", F.col("adjusted_trust").alias("trust"))

    def update_trust(self) -> DataFrame:
        return trust.update(self.base, trust.agreement(self.member, self.vectors()))

    def trust_board(self) -> DataFrame:
        return trust.board(self.update_trust())

    def narratives(self) -> DataFrame:
        """One row a narrative; see ``lineage.stories``."""
        return lineage.stories(self.member, self.roles, self.vectors(), self.now, FRAME)

    def find_narratives(self, texts: list[str], require_all: bool = True, min_trust: float = 0.0, limit: int = 20, ranking: str = "trust_recency") -> DataFrame:
        frames = lineage.frames(self.member, self.vectors()).select("cluster_id", (F.col("cos") < FRAME).alias("shifted")) if ranking == "frame" else None
        return intersection.find_narratives(self.member, self.roles, self.base, texts, self.now, require_all, min_trust, limit, ranking, frames)

    def materialize_context(self, chosen: list[int], most_articles: int = 10, most_paragraphs: int = 10) -> context.Context:
        return context.materialize_context(self.member, self.articles, self.base, chosen, most_articles, most_paragraphs)

    def search(self, query: str = "", range_name: str = "all", page: int = 1, limit: int = 20, today: str = "") -> search.Page:
        postings, documents = self._indexed()
        return search.search(postings, documents, query, range_name, page, limit, today, stemmed=True)

    def _indexed(self) -> tuple[DataFrame, DataFrame]:
        """The search index, written once for each state of the input files."""
        now = state(self.spark, self.sf_dir, "documents", "events")
        if self._index is None or self._index[0] != now:
            rows = self.articles.select("article_id", "title", "text", F.col("event_ts").alias("published"))
            self._index = (now, search.stored(rows, ("title", "text"), stemmed=True))
        return self._index[1]

    def query(self, prompt: str, embed: Callable[[str], list[float]], k: int = 8, min_trust: float = 0.0) -> DataFrame:
        """``(article_id, source_id, cos)`` of the nearest articles; trust is asked for after the k are chosen, so fewer may come."""
        rows = self.vectors().withColumnRenamed("x", "embedding").withColumnsRenamed({"article_id": "vec_id"}).withColumn("label", F.lit(0))
        near = boundary.nearest(rows, embed(prompt), k).select(F.col("vec_id").alias("article_id"), "cos")
        found = near.join(self.articles.select("article_id", "source_id"), "article_id").join(self.trusts(), "source_id", "left")
        return found.where(F.coalesce("trust", F.lit(intersection.UNKNOWN_TRUST)) >= min_trust).select("article_id", "source_id", "cos").orderBy(F.desc("cos"), "article_id")

    def story_sources(self, cluster_id: int, results: DataFrame) -> DataFrame:
        """Search results (source_id, ...) of the story's own sources alone."""
        own = self.member.where(F.col("cluster_id") == cluster_id).select("source_id").distinct()
        return results.join(own, "source_id", "left_semi")

    def run(self, summarize: Callable[[DataFrame], DataFrame] | None = None, most_stories: int | None = None, top: int = 8, pending: int = 10) -> Report:
        """Rebuild narratives, role links, trust and the brief into versioned tables.

        One file names the versions that belong together; it is replaced last, so ``published`` gives the tables of the
        last run that ended, whatever a run that goes on or broke off has written. What only older runs name is deleted
        then.

        ``summarize`` gets the pending articles (article_id, text) and gives (article_id, summary), which are merged into
        the table of summaries; articles in it are pending no longer.
        """
        tables = {n: VersionedTable(self.spark, f"{self.store}/{n}") for n in ("narratives", "links", "trust", "summaries", "brief")}
        rows = self.narratives()
        rows = rows.orderBy(F.coalesce("latest", F.lit("9999")).desc(), "cluster_id").limit(most_stories) if most_stories else rows
        stale = rebuild(tables["narratives"], rows, "narrative_id")
        first = self.roles.groupBy("role_id").agg(F.min("article_id").alias("article_id"))
        tables["links"].replace(first.join(self.member.select("article_id", "cluster_id"), "article_id").select("role_id", "cluster_id"))
        tables["trust"].replace(self.update_trust())
        waiting = self.articles.select("article_id", "text")
        if tables["summaries"].version():
            waiting = waiting.join(tables["summaries"].read().select("article_id"), "article_id", "left_anti")
        waiting = waiting.orderBy("article_id").limit(pending)
        if summarize:
            tables["summaries"].upsert(summarize(waiting), "article_id", "article_id")
        brief = tables["narratives"].read().orderBy(F.coalesce("latest", F.lit("9999")).desc(), "cluster_id").limit(top)
        tables["brief"].replace(brief.select("cluster_id", F.col("first_id").alias("article_id")))
        replace_text(self.spark, f"{self.store}/{RUN}", json.dumps({n: t.version() for n, t in tables.items() if t.version()}))
        for t in tables.values():
            t.vacuum()
        return Report(tables["narratives"].read(), stale, tables["links"].read(), waiting, tables["brief"].read(), tables["trust"].read())

    def published(self, name: str) -> DataFrame:
        """A table of the last run that ended: narratives, links, trust, summaries or brief."""
        run = read_text(self.spark, f"{self.store}/{RUN}")
        if run is None or name not in json.loads(run):
            raise FileNotFoundError(f"no run has published {name}")
        return self.spark.read.parquet(f"{self.store}/{name}/{json.loads(run)[name]}")

    def evaluate(self, found: DataFrame, path: str | None = None) -> DataFrame:
        """``(source_id, atoms, recalled, recall, base_trust, adjusted_trust)``: of each source's roles the share in ``found`` (role_id)."""
        own = self.roles.join(self.articles.select("article_id", "source_id"), "article_id").select("source_id", "role_id").distinct()
        hit = own.join(found.select("role_id").distinct().withColumn("hit", F.lit(1)), "role_id", "left")
        per = hit.groupBy("source_id").agg(F.count("*").alias("atoms"), F.count("hit").alias("recalled"))
        moved = self.update_trust().select("source_id", "base_trust", "adjusted_trust")
        out = per.withColumn("recall", F.round(F.col("recalled") / F.col("atoms"), 6)).join(moved, "source_id", "left")
        if path:
            out.write.mode("overwrite").json(path)
        return out

    def export_graph(self, path: str) -> None:
        """Nodes and edges as JSON: articles, roles and sources; an article's roles are its children."""
        name = F.concat(F.lit("a"), F.col("article_id").cast("string"))
        nodes = self.articles.select(name.alias("id"), F.lit("article").alias("kind")).unionByName(self.roles.select(F.col("role_id").alias("id"), F.lit("role").alias("kind")).distinct())
        nodes = nodes.unionByName(self.articles.select(F.col("source_id").alias("id"), F.lit("source").alias("kind")).distinct())
        edges = self.roles.select(name.alias("src"), F.col("role_id").alias("dst"), F.lit("child").alias("kind"))
        edges = edges.unionByName(self.articles.select(name.alias("src"), F.col("source_id").alias("dst"), F.lit("source").alias("kind")))
        nodes.write.mode("overwrite").json(f"{path}/nodes")
        edges.write.mode("overwrite").json(f"{path}/edges")
