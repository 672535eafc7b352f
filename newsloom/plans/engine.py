"""Catalogue entries of the callable operators, each with an oracle in DuckDB's SQL that states the rule a second time."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import hooks, page, recover
from newsloom.functions import text as T
from newsloom.keyed import KeyedTable, role_dimension, role_references
from newsloom.operators import browse, budget, context, crawl, identity, incremental, intersection, inverted, lineage, search, trust
from newsloom.plans.views import norm_sql, trust_of
from newsloom.session import shuffle_width
from newsloom.sources import feeds, registry, remote
from newsloom.storage import fresh_path, table
from newsloom.streaming import gate, ingest, windows
from newsloom.versioned import VersionedTable, rebuild

#: "Now" of the entries: the third day of the events, since documents have the first ones.
NOW, NOW_SEC, AGREE = "2024-01-04", 1704326400, 0.1
RANGES = ("today", "yesterday", "last_week", "last_month", "last_year", "all")
QUERY = "the thing license une"
FILES = "newsloom.sources.remote:from_files"


# Roles and narratives
def _texts(role: DataFrame) -> list[str]:
    """Two texts to look for: the most frequent role, and three words of another role of the first article that has it."""
    by = (F.xxhash64("norm").alias("h1"), F.xxhash64("role_id").alias("h2"))  # texts are counted by digests, and fetched for the most frequent
    n = role.groupBy(*by).agg(F.count("*").alias("n"), F.min("article_id").alias("a"))
    most = n.join(n.agg(F.max("n").alias("n")), "n").select("h1", "h2", "a")
    top = role.select("norm", *by).join(most, ["h1", "h2"]).agg(F.min(F.struct("norm", "a")).alias("top")).select("top.*").first()
    other = role.where((F.col("article_id") == top.a) & (F.col("norm") != top.norm)).agg(F.max("norm")).first()[0]
    return [top.norm, " ".join((other or top.norm).split(" ")[:3])]


def _narrative_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    arts = lineage.articles(spark, sf_dir)
    return lineage.members(spark, sf_dir), lineage.stored_roles(spark, sf_dir), trust_of(arts)


def role_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = lineage.stored_roles(spark, sf_dir)
    return intersection.match_roles(role, _texts(role)).orderBy(F.desc("score"), "spec", "norm")


def _find(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    member, role, known = _narrative_inputs(spark, sf_dir)
    return intersection.find_narratives(member, role, known, _texts(role), NOW_SEC, **options)


def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir)


def intersect_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir, require_all=False, ranking="sources", limit=50)


def intersect_min_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir, require_all=False, min_trust=0.6, ranking="trust", limit=50)


def narrative_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    member, _, known = _narrative_inputs(spark, sf_dir)
    return intersection.narrative_trust(member, known).select("cluster_id", intersection.two_places(F.col("trust")).alias("trust"))


_SPEC = f"""top AS (SELECT norm, min(article_id) AS a FROM role GROUP BY norm ORDER BY count(*) DESC, norm LIMIT 1),
    spec AS (SELECT 0 AS spec, {norm_sql('norm')} AS w FROM top UNION ALL SELECT 1, {norm_sql("array_to_string(string_split(coalesce(max(r.norm), max(top.norm)), ' ')[1:3], ' ')")}
        FROM top LEFT JOIN role r ON r.article_id = top.a AND r.norm <> top.norm),
    word AS (SELECT spec, role_id, norm, w, len(list_intersect(list_distinct(string_split(norm, ' ')), list_distinct(string_split(w, ' ')))) /
        CAST(greatest(len(list_distinct(string_split(norm, ' '))), len(list_distinct(string_split(w, ' ')))) AS DOUBLE) AS share FROM (SELECT DISTINCT role_id, norm FROM role ) CROSS JOIN spec),
    fit AS (SELECT spec, role_id, norm, round(CASE WHEN norm = w THEN 1.0 WHEN contains(norm, w) OR contains(w, norm) THEN 0.95 WHEN share >= 0.5 THEN 0.8 + 0.15 * share END::DOUBLE, 6) AS score FROM word)"""
_FOUND = f"""WITH RECURSIVE {_SPEC}, held AS (SELECT m.cluster_id, count(DISTINCT f.spec) AS satisfied FROM member m JOIN role r ON r.article_id = m.article_id JOIN fit f ON f.role_id = r.role_id AND f.score IS NOT NULL GROUP BY 1),
    mean AS (SELECT cluster_id, avg(coalesce(trust, 0.5)) AS t FROM (SELECT DISTINCT cluster_id, source_id FROM member ) LEFT JOIN trust USING (source_id) GROUP BY 1),
    found AS (SELECT h.cluster_id, h.satisfied, (SELECT count(DISTINCT spec) FROM fit WHERE score IS NOT NULL) AS total, CAST(round(CAST(t AS DECIMAL(18, 9)), 2) AS DOUBLE) AS trust_score, source_count, latest,
        CAST(CASE WHEN sec IS NULL THEN 9999 ELSE greatest(0, floor(({NOW_SEC} - sec) / 86400.0)) END AS INT) AS days, t
        FROM held h JOIN mean USING (cluster_id) JOIN (SELECT cluster_id, count(DISTINCT source_id) AS source_count, max(event_ts) AS latest, max(event_sec) AS sec FROM member GROUP BY 1) USING (cluster_id))
    SELECT cluster_id, satisfied, total, trust_score, source_count, latest, days FROM found WHERE """


def narrative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    member, role, _ = _narrative_inputs(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("x"))
    return lineage.stories(member, role, vectors, NOW_SEC, 0.3).drop("frame_shift_note", "last_id")


def narrative_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve roles of each narrative, over the roles that are kept; the SQL is the catalogue's."""
    return lineage.entities(lineage.members(spark, sf_dir), lineage.stored_roles(spark, sf_dir))


def narratives_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives of all articles, taken up in three batches that are mixed in time."""
    arts, state = lineage.articles(spark, sf_dir), incremental.Narratives(spark, fresh_path(spark, "narratives"))
    for k in (2, 0, 1):
        state.add(arts.where(F.pmod("article_id", F.lit(3)) == k))
    return state.members().select("cluster_id", "article_id", "source_id", "event_ts", "rn")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = lineage.members(spark, sf_dir)
    first = member.groupBy("cluster_id").agg(F.min("event_ts").alias("first_seen"))
    return lineage.narratives(member).join(first, "cluster_id").withColumn("last_updated", F.col("latest"))


def narrative_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each order, asked for with more rows than a page has."""
    rows, out = _listed(spark, sf_dir), []
    for sort in (*browse.ORDERS, "unknown"):
        page = browse.page_of(rows, sort, 0, 500)
        out.append(page.rows.select(F.lit(sort).alias("sort"), "place", "cluster_id", F.lit(page.total).cast("long").alias("total"), F.lit(page.total_pages).cast("long").alias("total_pages")))
    return reduce(DataFrame.unionByName, out)


def narrative_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narratives of each named range before a moment in the middle of a day; undated ones are in all."""
    rows = _listed(spark, sf_dir)
    each = [rows.where(browse.in_range(n, F.col("latest"), f"{NOW} 12:00:00")).select(F.lit(n).alias("range"), "cluster_id") for n in RANGES]
    return reduce(DataFrame.unionByName, each)


def narrative_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives of two sources or more, one of which holds ``rc1``, from the day before on, fewest sources first."""
    rows = browse.screen(_listed(spark, sf_dir), f"{NOW} 12:00:00", 2, "yesterday", "rc1")
    return browse.page_of(rows, "sources-asc", 1, 20, orders=browse.SCREEN_ORDERS).rows.select("place", "cluster_id", "n_sources", "latest")


def narrative_role_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of narratives by their articles and by the stories that roles name: here each role names its last article's."""
    member, role = lineage.members(spark, sf_dir), lineage.stored_roles(spark, sf_dir)
    last = role.groupBy("role_id").agg(F.max("article_id").alias("article_id"))
    stories = last.join(member.select("article_id", "cluster_id"), "article_id")
    return browse.roles_of(member, role.where("article_id % 2 = 0"), stories)


def role_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles with the narrative that they belong to, of those of the last day."""
    rows = _listed(spark, sf_dir)
    shown = rows.where(browse.in_range("yesterday", F.col("latest"), f"{NOW} 12:00:00"))
    return browse.role_stories(lineage.members(spark, sf_dir), lineage.stored_roles(spark, sf_dir), shown)


# Identity
def _remap(rows: DataFrame) -> DataFrame:
    """Roles that begin alike become the one with the smallest id."""
    own = rows.select("role_id", F.substring("norm", 1, 12).alias("head")).distinct()
    first = own.groupBy("head").agg(F.min("role_id").alias("new_id"))
    return own.join(first, "head").select(F.col("role_id").alias("old_id"), "new_id")


def merge_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = lineage.stored_roles(spark, sf_dir)
    rows = role.groupBy("role_id").agg(F.min("norm").alias("text"), F.array_sort(F.collect_set("article_id")).alias("references"))
    rows = rows.withColumn("merged_from", F.array().cast("array<string>"))
    out = identity.merge_roles(rows, identity.resolve(_remap(role), role))
    return out.select("role_id", "text", "reference_count", "is_association", F.array_join("merged_from", ",").alias("merged_from"))


def merge_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = lineage.stored_roles(spark, sf_dir)
    lists = role.groupBy("article_id").agg(F.array_sort(F.collect_list("role_id")).alias("role_figments"))
    out = identity.merge_lists(lists, "article_id", "role_figments", identity.resolve(_remap(role), role))
    return out.select("article_id", F.array_join("role_figments", ",").alias("role_figments"))


def _customers(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") - F.col("c_custkey") % modulus).alias("new_id"))


def merge_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_nationkey") + 1000000).cast("long").alias("b"), (F.col("c_custkey") % 10 / 10).alias("confidence"))
    return identity.merge_links(links, _customers(spark, sf_dir, 5), "what")


def merge_dedup_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("a"), (F.col("c_custkey") + 7).alias("b"), F.col("c_mktsegment").alias("verdict"))
    return identity.merge_observations(rows, _customers(spark, sf_dir, 10))


def assoc_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 7).alias("b"))
    return identity.groups(links)


def assoc_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_nationkey") + 1000000).cast("long").alias("b"))
    return identity.expand(links, links.where("a = 1").select(F.col("a").alias("id")))


def assoc_propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return identity.propose(names.select("id", F.lit("what").alias("role"), F.col("p_name").alias("norm"))).drop("seen_together")


_MAP = "remap AS (SELECT role_id AS old_id, min(role_id) OVER (PARTITION BY substr(norm, 1, 12)) AS new_id FROM (SELECT DISTINCT role_id, norm FROM role ))"
_FIG = "substr(sha256('assoc:what:' || least(a, b) || ':' || greatest(a, b)), 1, 16)"


# Trust
def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    member, _, known = _narrative_inputs(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings")
    own = member.select("article_id", (F.col("article_id") % emb.count()).alias("vec_id"))
    vectors = own.join(emb, "vec_id").select("article_id", F.col("embedding").alias("x"))
    return trust.update(known, trust.agreement(member, vectors, AGREE))


def trust_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir)


def trust_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.board(_updated(spark, sf_dir))


def trust_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir).select("source_id", F.col("base_trust").alias("before_trust"), F.col("adjusted_trust").alias("after_trust"))


_TRUST = f"""WITH RECURSIVE unit AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: v / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-10)) AS x FROM embeddings),
    part AS (SELECT m.cluster_id, m.source_id, unnest(u.x) AS v, generate_subscripts(u.x, 1) AS k FROM member m JOIN unit u ON u.vec_id = m.article_id % (SELECT count(*) FROM embeddings)),
    mean AS (SELECT cluster_id, source_id, k, avg(v) AS v FROM part GROUP BY 1, 2, 3),
    pairs AS (SELECT p.cluster_id, p.source_id, q.source_id AS other, round(sum(p.v * q.v), 9) AS cos FROM mean p JOIN mean q ON p.cluster_id = q.cluster_id AND p.k = q.k AND p.source_id <> q.source_id GROUP BY 1, 2, 3),
    agreed AS (SELECT source_id, count(*) AS related, count(CASE WHEN cos >= {AGREE} THEN 1 END) AS agreeing FROM pairs GROUP BY 1),
    updated AS (SELECT t.source_id, t.trust AS base_trust, coalesce(related, 0) AS related, coalesce(agreeing, 0) AS agreeing, coalesce(related - agreeing, 0) AS contradicting, round(agreeing / CAST(related AS DOUBLE), 6) AS corroborated,
        round(CASE WHEN related > 0 THEN least(1.0, greatest(0.0, t.trust + 0.1 * (2 * (agreeing / CAST(related AS DOUBLE)) - 1))) ELSE t.trust END, 6) AS adjusted_trust FROM trust t LEFT JOIN agreed USING (source_id)) """


# Crawl, sources, files
def bfs_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda kind, c: F.concat(F.lit(kind), F.lpad(F.col(c).cast("string"), 9, "0"))
    down = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    links = down.unionByName(customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = down.where("src IN ('r000000000', 'r000000003')").select(F.col("src").alias("node"))
    return crawl.crawl(links, seeds, 2, 200, ~F.col("node").endswith("7"))


def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(T.domain(F.col("url")).alias("host")).distinct()
    text = F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/ # closed\nDisallow:\n")
    return crawl.may_fetch(pages, crawl.robots_rules(hosts.where("length(host) % 2 = 0").select("host", text.alias("text"))))


def feed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineage.articles(spark, sf_dir).where("event_sec IS NOT NULL AND title <> ''")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), T.escape_html(c), F.lit(f"</{name}>"))
    date = F.date_format(F.timestamp_seconds("event_sec"), "dd MMM yyyy HH:mm:ss")
    item = F.concat(
        F.lit("<item>"), tag("title", F.col("title")), tag("link", F.concat(F.lit("http://n/"), F.col("article_id").cast("string"))),
        tag("pubDate", F.concat(date, F.lit(" +0000"))), tag("description", F.concat(F.col("source_id"), F.lit(": "), F.col("title"))),
        F.lit('<enclosure url="http://n/'), F.col("article_id").cast("string"), F.lit('.PNG"/></item>'),
    )
    path = fresh_path(spark, "feed")
    # A file is one document, so items are gathered in as many as the shuffle is wide.
    files = rows.select(F.pmod("article_id", F.lit(shuffle_width(spark))).alias("file"), item.alias("item")).groupBy("file").agg(F.array_join(F.collect_list("item"), "").alias("items"))
    files.select("file", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value")).write.partitionBy("file").text(path)
    got = feeds.read_feed(spark, path, "all", since="2024-01-02T00:00:00Z", before="2024-01-02")
    return got.select("source_id", "text", "url", "title", "image_url", F.unix_seconds(T.mail_time(F.col("published"))).alias("sec"))


def _feed_folders(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """A feed for each source, of its titles, in a folder of its own."""
    rows = lineage.articles(spark, sf_dir).where("title <> '' AND source_id IS NOT NULL")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), T.escape_html(c), F.lit(f"</{name}>"))
    item = F.concat(F.lit("<item>"), tag("title", F.col("title")), tag("link", F.concat(F.lit("http://n/"), F.col("article_id").cast("string"))), tag("description", F.col("title")), F.lit("</item>"))
    path = fresh_path(spark, "feeds")
    files = rows.select("source_id", item.alias("item")).groupBy("source_id").agg(F.array_join(F.collect_list("item"), "").alias("items"))
    files.select("source_id", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value")).write.partitionBy("source_id").text(path)
    return {r.source_id: f"{path}/source_id={r.source_id}" for r in rows.select("source_id").distinct().collect()}


def feed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of all sources through the data source, as a table."""
    got = remote.fetch_feeds(spark, _feed_folders(spark, sf_dir), transport=FILES, strict="true")
    return feeds.articles_of(got).select("source_id", "text", "url", "title")


def feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feeds as a stream: one poll, written to a table."""
    got = remote.fetch_feeds(spark, _feed_folders(spark, sf_dir), stream=True, transport=FILES, strict="true")
    path = fresh_path(spark, "polled")
    rows = feeds.articles_of(got).select("source_id", "text", "url", "title")
    rows.writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, "poll")).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path)


def search_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the results of a search in three pages, up to a thousand of them, as articles."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.pmod("page_id", F.lit(3)).alias("p"))
    path, result = fresh_path(spark, "results"), F.to_json(F.struct("url", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title")))
    body = F.concat(F.lit('{"results": ['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", result.alias("r")))), lambda x: x["r"]), ", "), F.lit("]}"))
    pages.groupBy((F.col("p") + 1).alias("pageno")).agg(body.alias("value")).write.partitionBy("pageno").text(path)
    got = remote.search_web(spark, path, "news", 1000, pages=4, transport=FILES, retries="0")
    return feeds.search_articles(got).select("url", "title", "source_id")


def _labeler() -> hooks.Model:
    words = {"en": " the ", "de": " der ", "fr": " les ", "es": " que "}
    return lambda texts: [next((k for k, w in words.items() if w in t), "none") for t in texts]


def label_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelling hook over the documents, loaded once by each worker."""
    return hooks.Hook(_labeler).apply(table(spark, sf_dir, "documents"), "text", "label").select("doc_id", "label", "label_error")


def page_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(page.blocks(html)).cast("long").alias("n_blocks"), page.main_text(html).alias("text"))


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with tags and an object as other sites write them, made of the page's own columns."""
    tags = F.concat(
        F.lit("<META content='By &quot;"), T.domain(F.col("url")), F.lit("&quot;' name=author><meta name=\"Author\" content=\""), T.domain(F.col("url")),
        F.lit('"><script type="application/ld+json">{"datePublished": "2024-01-0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('", "publisher": {"name": "P'), F.col("page_id").cast("string"), F.lit('"}}</script>'),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", page.metadata(F.concat("html", tags)).alias("m"))
    return rows.select("page_id", "m.title", "m.author", "m.published", "m.site", "m.image")


def feed_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles that a run of a hundred takes, from all feeds alike."""
    return budget.within_budget(lineage.articles(spark, sf_dir).select("article_id", "source_id"), 100)


def feed_budget_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that ends before the last feeds."""
    return budget.within_budget(lineage.articles(spark, sf_dir).select("article_id", "source_id"), 7)


def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = F.concat(F.lit('<think>{"k": 0}</think>Here it is: {not json} '), "props", F.lit(" as asked"))
    answer = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, noise).otherwise("no object")
    return table(spark, sf_dir, "events").select("event_id", recover.recover_json(answer).alias("found"))


def registry_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trust_of(lineage.articles(spark, sf_dir)).where("source_id IS NOT NULL")
    body = F.map_from_entries(F.collect_list(F.struct("source_id", F.struct(F.upper("source_id").alias("name"), F.col("trust").alias("base_trust")))))
    text = F.concat(F.lit('{"feeds": {"a": "http://a"}, "crawler": {"max_depth": 2}, '), F.substring(F.to_json(body), 2, 1 << 30))
    path = fresh_path(spark, "registry")
    rows.agg(text.alias("value")).coalesce(1).write.text(path)
    known = registry.load(spark, path)
    more = spark.createDataFrame([("src1", 0.0), ("wire", 0.9)], "source_id string, base_trust double")
    return registry.ensure(known, more).select("source_id", "name", "base_trust")


def title_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineage.articles(spark, sf_dir).select(F.col("article_id").alias("id"), "source_id", "title")
    known = rows.where("id % 2 = 0").select("source_id", "title", F.col("id").alias("at"))
    return recover.new_titles(rows.where("id % 2 = 1"), known).select("id", "source_id", "title")


# Tables in versions, streams
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    store = VersionedTable(spark, fresh_path(spark, "customers"))
    store.replace(base)
    new = base.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    store.upsert(new.unionByName(new.limit(5).selectExpr("c_custkey + 10000000 AS c_custkey", "0D AS c_acctbal")), "c_custkey", "c_acctbal")
    store.delete(base.where("c_custkey % 7 = 0"), "c_custkey")
    store.compact(2)
    store.vacuum()
    return store.read().where("c_custkey < 10000000")


def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in buckets after an upsert with repeated keys and a delete, each of which rewrites its own buckets."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(0).alias("at"))
    store = KeyedTable(spark, fresh_path(spark, "keyed"), ("c_custkey",), 16)
    store.upsert(base, "at")
    new = base.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_acctbal") + 1, F.lit(2).alias("at")).toDF("c_custkey", "c_acctbal", "at")
    store.upsert(new.unionByName(base.withColumns({"c_acctbal": F.lit(0.0), "at": F.lit(1)}).where("c_custkey % 4 = 0")), "at")
    store.delete(base.where("c_custkey % 7 = 0"))
    return store.read().drop("at")


def role_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of articles that come in two batches, the second one twice."""
    role = lineage.stored_roles(spark, sf_dir)
    store = role_references(spark, fresh_path(spark, "references"), 16)
    for part in ("article_id % 2 = 1", "article_id % 2 = 0", "article_id % 2 = 0"):
        store.upsert(role.where(part), "article_id")
    return role_dimension(store.read())


def merge_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were ordered together, after parts became the first of their ten."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    one, two = own.withColumnRenamed("l_partkey", "a"), own.withColumnRenamed("l_partkey", "b")
    # Each meeting weighs one: the merge adds them up, so pairs of parts are not counted before.
    rels = one.join(two, "l_orderkey").where("a < b").select("a", "b", F.lit(1).cast("long").alias("weight"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("new_id"))
    return identity.merge_edges(rels, part).drop("figment_id")


def lineage_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rebuild without the articles of one source makes readers forget."""
    member = lineage.members(spark, sf_dir)
    store = VersionedTable(spark, fresh_path(spark, "lineage"))
    store.replace(lineage.narratives(member))
    return rebuild(store, lineage.narratives(member.where("source_id <> 'src0'")), "narrative_id").select(F.col("narrative_id").alias("stale_id"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as two drops of files, the second a repeat, through the stream into a table."""
    pages = table(spark, sf_dir, "pages").select("url", T.visible_text(F.col("html")).alias("text"))
    source, target = fresh_path(spark, "drop"), VersionedTable(spark, fresh_path(spark, "ingested"))
    checkpoint = fresh_path(spark, "stream")
    for _ in range(2):
        pages.write.mode("append").json(source)
        ingest.ingest(spark, source, "url string, text string", target, checkpoint).awaitTermination()
    return target.read().select("url", F.length("text").cast("long").alias("n_chars"))


def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over feeds that are the documents' sources; the second polls the same articles again."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("source_id"), F.concat(F.lit("http://x/"), "doc_id").alias("url"), F.lit(None).cast("string").alias("title"), "text", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("at"))
    source, target = fresh_path(spark, "polls"), VersionedTable(spark, fresh_path(spark, "gated"))
    checkpoint = fresh_path(spark, "checkpoint")
    names = [r[0] for r in docs.where("source IS NOT NULL").select("source").distinct().collect()]
    for run in range(2):
        rows.write.mode("append").json(source)
        polled = spark.readStream.schema(rows.schema).json(source)
        gate.follow_feeds(polled, target, checkpoint, names, 60, run).awaitTermination()
    return target.read().select("source_id", "url", F.char_length("text").cast("long").alias("n_chars"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.counts(rows, "ts", ["event_type"], "1 day", "12 hours")
    return out.select(F.unix_seconds("start").alias("start_sec"), "event_type", "n")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    out = windows.sessions(rows, "ts", ["user_id"], "6 hours")
    return out.select(F.unix_seconds("start").alias("start_sec"), F.unix_seconds("end").alias("end_sec"), "user_id", "n")


# Search
def _postings(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> tuple[DataFrame, DataFrame]:
    arts = lineage.articles(spark, sf_dir).select("article_id", "text", F.col("event_ts").alias("published"))
    return search.stored(arts, ("text",), stemmed=stemmed)


def fts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, docs = _postings(spark, sf_dir)
    return search.search(postings, docs, QUERY).hits.select("article_id", "score")


def fts_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``fts_search``, over stems. No oracle has the stemmer; a test holds ranks and scores against SQLite's index."""
    postings, docs = _postings(spark, sf_dir, True)
    return search.search(postings, docs, QUERY, stemmed=True).hits.select("article_id", "score")


def fts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, docs = _postings(spark, sf_dir)
    got = search.search(postings, docs, QUERY, "yesterday", 2, 10, NOW)
    return got.hits.select("article_id", F.lit(got.total).cast("long").alias("total"), F.lit(got.total_pages).alias("total_pages"))


def _changed(spark: SparkSession, sf_dir: str) -> tuple[inverted.Index, DataFrame]:
    """An index after changes: a third of the articles with a text of before, two thirds as they are, some deleted."""
    arts = lineage.articles(spark, sf_dir).select("article_id", "title", "text", "source_id", F.col("event_ts").alias("published"))
    index = inverted.Index.create(spark, fresh_path(spark, "index"), ("title", "text", "source_id"), buckets=16, blocks=32)
    index.upsert(arts.where("article_id % 3 <> 0").withColumn("text", F.concat(F.lit("license thing "), "text")))
    index.upsert(arts.where("article_id % 3 <> 1"))
    index.delete(arts.where("article_id % 7 = 0"))
    return index, arts


def fts_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a changed index, with their articles."""
    index, arts = _changed(spark, sf_dir)
    return inverted.hydrate(index.search(QUERY), arts).select("article_id", "score", "title", "source_id")


def fts_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the titles alone, after a merge."""
    index, _ = _changed(spark, sf_dir)
    index.merge()
    return index.search(QUERY, columns=("title",)).select("article_id", "score")


def fts_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = lineage.articles(spark, sf_dir)
    return arts.where(search.in_range("yesterday", F.col("event_ts"), NOW)).select("article_id", "event_ts")


def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events lie in each named range."""
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("p"))
    each = [rows.where(search.in_range(name, F.col("p"), "2024-01-20")).agg(F.count("*").alias("n")).withColumn("range", F.lit(name)) for name in RANGES]
    return reduce(DataFrame.unionByName, each)


def context_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest five narratives' context: totals, and how long the text is."""
    member, _, known = _narrative_inputs(spark, sf_dir)
    top = [r.cluster_id for r in lineage.narratives(member).orderBy(F.desc("n"), "cluster_id").limit(5).select("cluster_id").collect()]
    got = context.materialize_context(member, lineage.articles(spark, sf_dir), known, top)
    sizes = got.paragraphs.groupBy("cluster_id").agg(F.count("*").alias("paragraphs"))
    return got.narratives.join(sizes, "cluster_id", "left").select("cluster_id", "member_count", F.array_join("sources", ",").alias("sources"), "paragraphs").crossJoin(got.totals)


_TERMS = f"""tok AS (SELECT article_id, unnest(ws) AS term, len(ws) AS length FROM (SELECT article_id, regexp_extract_all(translate(lower(text), '{search.MARKED}', '{search.PLAIN}'), '[\\p{{L}}\\p{{N}}]+') AS ws FROM article )),
    doc AS (SELECT DISTINCT article_id, length FROM tok),
    tf AS (SELECT article_id, term, count(*) AS tf FROM tok WHERE term IN ('the', 'thing', 'license', 'une') GROUP BY 1, 2),
    idf AS (SELECT term, CASE WHEN i > 0 THEN i ELSE 1e-6 END AS idf FROM (SELECT term, ln(((SELECT count(*) FROM doc) - count(*) + 0.5) / (count(*) + 0.5)) AS i FROM tf GROUP BY 1)),
    hit AS (SELECT article_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(length) FROM doc)))), 6) AS score FROM tf JOIN idf USING (term) JOIN doc USING (article_id) GROUP BY 1)"""
_PLAIN = "{}"
for _name, _sign in page.ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_name.replace(chr(39), chr(39) * 2)}', '{_sign.replace(chr(39), chr(39) * 2)}')"
_PLAIN = f"trim(regexp_replace({_PLAIN}, '[ \\t\\r\\n\u00a0]+', ' ', 'g'))"
_HOST = r"lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"

_INDEXED = f"""fields AS (SELECT article_id, title AS t, CASE WHEN article_id % 3 = 1 THEN 'license thing ' || text ELSE text END AS x, source_id AS s FROM article WHERE article_id % 7 <> 0),
    words AS (SELECT article_id, {", ".join(f"coalesce(regexp_extract_all(translate(lower({c}), '{search.MARKED}', '{search.PLAIN}'), '[\\p{{L}}\\p{{N}}]+'), []) AS {c}" for c in "txs")} FROM fields),
    size AS (SELECT article_id, CAST(len(t) + len(x) + len(s) AS DOUBLE) AS length FROM words),
    tok AS (SELECT article_id, unnest(ASKED) AS term FROM words), tf AS (SELECT article_id, term, count(*) AS tf FROM tok WHERE term IN ('the', 'thing', 'license', 'une') GROUP BY 1, 2),
    idf AS (SELECT term, CASE WHEN i > 0 THEN i ELSE 1e-6 END AS idf FROM (SELECT term, ln(((SELECT count(*) FROM size) - count(*) + 0.5) / (count(*) + 0.5)) AS i FROM tf GROUP BY 1)),
    hit AS (SELECT article_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(length) FROM size)))), 6) AS score FROM tf JOIN idf USING (term) JOIN size USING (article_id) GROUP BY 1)"""
_BUDGET = "WITH RECURSIVE k AS (SELECT article_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY article_id) AS k FROM article WHERE source_id IS NOT NULL) SELECT article_id, source_id FROM k WHERE k <= greatest(1, MOST // (SELECT count(DISTINCT source_id) FROM k)) ORDER BY source_id, k LIMIT MOST"
#: Oracles that name relations of ``views``; and those over the tables alone.
OVER_VIEWS = {
    "role_match": f"WITH RECURSIVE {_SPEC} SELECT spec, role_id, norm, score FROM fit WHERE score IS NOT NULL",
    "intersect_all": _FOUND + "satisfied = 2 ORDER BY round(trust_score * 0.6 + 0.4 / (1 + days), 9) DESC, cluster_id LIMIT 20",
    "intersect_any": _FOUND + "true ORDER BY source_count DESC, cluster_id LIMIT 50",
    "intersect_min_trust": _FOUND + "round(t, 9) >= 0.6 ORDER BY trust_score DESC, cluster_id LIMIT 50",
    "narrative_trust": "SELECT cluster_id, CAST(round(CAST(avg(coalesce(trust, 0.5)) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS trust FROM (SELECT DISTINCT cluster_id, source_id FROM member ) LEFT JOIN trust USING (source_id) GROUP BY 1",
    "narrative_rows": f"""WITH RECURSIVE extra AS (SELECT cluster_id, min_by(title, rn) AS title, min(event_ts) AS first_seen, count(CASE WHEN event_sec >= {NOW_SEC - 86400} THEN 1 END) AS new_article_count, count(*) - 1 AS derivatives FROM member GROUP BY 1),
        ent AS (SELECT cluster_id, string_agg(norm, '|' ORDER BY norm) AS entities FROM (SELECT cluster_id, norm, row_number() OVER (PARTITION BY cluster_id ORDER BY norm) AS k FROM (SELECT DISTINCT m.cluster_id, r.norm FROM member m JOIN role r ON r.article_id = m.article_id WHERE length(r.norm) >= 3)) WHERE k <= 12 GROUP BY 1),
        shift AS (SELECT n.cluster_id, round(list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(l.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[]))) + 1e-10), 6) AS cos
            FROM narr n JOIN embeddings f ON f.vec_id = n.first_id JOIN embeddings l ON l.vec_id = n.last_id WHERE n.n >= 2)
        SELECT n.cluster_id, n.n, n.members, n.sources, n.n_sources, n.latest, n.first_id, n.first_source, n.narrative_id, title, first_seen, new_article_count, derivatives, coalesce(entities, '') AS entities, cos AS frame_shift_score, coalesce(cos < 0.3, false) AS frame_shift
        FROM narr n JOIN extra USING (cluster_id) LEFT JOIN ent USING (cluster_id) LEFT JOIN shift USING (cluster_id)""",
    "narratives_incremental": "SELECT cluster_id, article_id, source_id, event_ts, rn FROM member",
    "role_upsert": "SELECT role_id, norm, min(article_id) AS first_article_id, count(*) AS reference_count FROM role GROUP BY role_id, norm",
    "narrative_sorts": "WITH RECURSIVE listed AS (SELECT n.*, f.first_seen FROM narr n JOIN (SELECT cluster_id, min(event_ts) AS first_seen FROM member GROUP BY 1) f USING (cluster_id)), placed AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS sort, CAST(row_number() OVER (ORDER BY {o}, cluster_id) AS INT) AS place, cluster_id FROM listed" for n, o in (
        ("newest", "first_seen DESC NULLS LAST"), ("updated", "latest DESC NULLS LAST"), ("oldest", "first_seen ASC NULLS FIRST"), ("sources", "n_sources DESC"), ("latest", "latest DESC NULLS LAST"), ("unknown", "latest DESC NULLS LAST")))
    + ") SELECT *, (SELECT count(*) FROM narr ) AS total, CAST(ceil((SELECT count(*) FROM narr ) / 100.0) AS BIGINT) AS total_pages FROM placed WHERE place <= 100",
    "narrative_ranges": "WITH RECURSIVE d AS (SELECT cluster_id, CAST(latest AS TIMESTAMP) AS t FROM narr ) SELECT range, cluster_id FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS range, cluster_id FROM d WHERE t IS NULL OR ({c})" for n, c in (
        ("today", "t >= '2024-01-04'"), ("yesterday", "t >= '2024-01-03' AND t < '2024-01-04'"), ("last_week", "t >= '2023-12-28 12:00:00'"), ("last_month", "t >= '2023-12-05 12:00:00'"), ("last_year", "t >= '2023-01-04 12:00:00'"), ("all", "true"))) + ")",
    "narrative_screen": "SELECT CAST(row_number() OVER (ORDER BY n_sources, cluster_id) AS INT) AS place, cluster_id, n_sources, latest FROM narr WHERE n_sources >= 2 AND latest >= '2024-01-03' AND position('rc1' IN sources) > 0 ORDER BY place LIMIT 20",
    "narrative_role_union": "SELECT m.cluster_id, r.role_id FROM member m JOIN role r ON r.article_id = m.article_id WHERE r.article_id % 2 = 0 UNION SELECT m.cluster_id, l.role_id FROM (SELECT role_id, max(article_id) AS article_id FROM role GROUP BY 1) l JOIN member m ON m.article_id = l.article_id",
    "role_stories": "SELECT p.role_id, p.n AS count, s.cluster_id FROM (SELECT role_id, count(*) AS n, min(article_id) AS article_id FROM role GROUP BY 1) p LEFT JOIN (SELECT m.article_id, m.cluster_id FROM member m JOIN narr n ON n.cluster_id = m.cluster_id WHERE n.latest IS NULL OR (n.latest >= '2024-01-03' AND n.latest < '2024-01-04')) s ON s.article_id = p.article_id",
    "merge_roles": f"""WITH RECURSIVE {_MAP}, own AS (SELECT new_id, old_id, r.article_id, r.norm FROM remap JOIN role r ON r.role_id = old_id)
        SELECT new_id AS role_id, min(CASE WHEN old_id = new_id THEN norm END) AS text, count(DISTINCT article_id) AS reference_count, count(DISTINCT old_id) > 1 AS is_association,
        coalesce(string_agg(DISTINCT CASE WHEN old_id <> new_id THEN old_id END, ',' ORDER BY CASE WHEN old_id <> new_id THEN old_id END), '') AS merged_from FROM own GROUP BY 1""",
    "merge_bridge": f"WITH RECURSIVE {_MAP} SELECT article_id, string_agg(new_id, ',' ORDER BY first_old) AS role_figments FROM (SELECT article_id, new_id, min(old_id) AS first_old FROM role JOIN remap ON role_id = old_id GROUP BY 1, 2) GROUP BY 1",
    "trust_update": _TRUST + "SELECT * FROM updated",
    "trust_board": _TRUST + "SELECT *, round(adjusted_trust - base_trust, 6) AS shift FROM updated",
    "trust_shift": _TRUST + "SELECT source_id, base_trust AS before_trust, adjusted_trust AS after_trust FROM updated",
    "feed_parse": "SELECT 'all' AS source_id, source_id || ': ' || title AS text, 'http://n/' || article_id AS url, title, 'http://n/' || article_id || '.PNG' AS image_url, event_sec AS sec FROM article WHERE title <> '' AND event_sec BETWEEN 1704153600 AND 1704239999",
    "registry_load": "SELECT source_id, upper(source_id) AS name, trust AS base_trust FROM trust WHERE source_id IS NOT NULL UNION ALL SELECT 'wire', NULL, 0.9",
    "lineage_rebuild": "SELECT narrative_id AS stale_id FROM narr WHERE narrative_id NOT IN (SELECT 'narrative:' || substr(sha1(string_agg(CAST(article_id AS VARCHAR), '|' ORDER BY rn)), 1, 12) FROM member WHERE source_id <> 'src0' GROUP BY cluster_id)",
    "fts_search": f"WITH RECURSIVE {_TERMS} SELECT * FROM hit ORDER BY score, article_id LIMIT 20",
    "fts_page": f"WITH RECURSIVE {_TERMS}, own AS (SELECT h.* FROM hit h JOIN article a ON a.article_id = h.article_id WHERE event_ts >= '2024-01-03' AND event_ts < '2024-01-04') SELECT article_id, (SELECT count(*) FROM own) AS total, CAST(ceil((SELECT count(*) FROM own) / 10.0) AS INT) AS total_pages FROM own ORDER BY score, article_id LIMIT 10 OFFSET 10",
    "fts_upsert": f"WITH RECURSIVE {_INDEXED.replace('ASKED', 't || x || s')} SELECT h.article_id, score, title, source_id FROM (SELECT * FROM hit ORDER BY score, article_id LIMIT 20) h JOIN article USING (article_id)",
    "fts_column": f"WITH RECURSIVE {_INDEXED.replace('ASKED', 't')} SELECT * FROM hit ORDER BY score, article_id LIMIT 20",
    "label_hook": "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' les ') THEN 'fr' WHEN contains(text, ' que ') THEN 'es' ELSE 'none' END AS label, CAST(NULL AS VARCHAR) AS label_error FROM documents",
    "page_main": f"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(html, chr(1) || chr(2), ''), '{page.GONE}', ' ', 'g'),
        '{page.LINK}', chr(1), 'g'), '{page.LINK_END}', chr(2), 'g'), '{page.BREAK}', ' ', 'g') AS t FROM pages),
        part AS (SELECT page_id, generate_subscripts(x, 1) AS i, regexp_replace(unnest(x), '<[^>]*>', '', 'g') AS raw FROM (SELECT page_id, regexp_split_to_array(t, '{page.BLOCK}') AS x FROM bare)),
        block AS (SELECT page_id, i, {_PLAIN.format("translate(raw, chr(1) || chr(2), '')")} AS text, {_PLAIN.format("replace(array_to_string(regexp_extract_all(raw, chr(1) || '[^' || chr(2) || ']*'), ' '), chr(1), '')")} AS links FROM part),
        n AS (SELECT *, len(string_split(text, ' ')) AS w, CASE links WHEN '' THEN 0 ELSE len(string_split(links, ' ')) END / len(string_split(text, ' ')) AS d FROM block WHERE text <> ''),
        near AS (SELECT *, coalesce(lag(w) OVER o, 0) AS pw, coalesce(lag(d) OVER o, 0) AS pd, coalesce(lead(w) OVER o, 0) AS nw FROM n WINDOW o AS (PARTITION BY page_id ORDER BY i)),
        kept AS (SELECT page_id, count(*) AS n_blocks, string_agg(text, chr(10) ORDER BY i) FILTER (d <= 1 / 3 AND CASE WHEN pd <= 5 / 9 THEN w > 16 OR nw > 15 OR pw > 4 ELSE w > 40 OR nw > 17 END) AS text FROM near GROUP BY 1)
        SELECT page_id, coalesce(n_blocks, 0) AS n_blocks, coalesce(text, '') AS text FROM pages LEFT JOIN kept USING (page_id)""",
    "page_metadata": f"""SELECT page_id, nullif({_PLAIN.format("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')")}, '') AS title, {_HOST.format('url')} AS author,
        '2024-01-0' || (page_id % 9 + 1) AS published, 'P' || page_id AS site, CAST(NULL AS VARCHAR) AS image FROM pages""",
    "feed_budget": _BUDGET.replace("MOST", "100"),
    "feed_budget_tight": _BUDGET.replace("MOST", "7"),
    "feed_source": "SELECT source_id, title AS text, 'http://n/' || article_id AS url, title FROM article WHERE title <> '' AND source_id IS NOT NULL",
    "feed_stream": "SELECT source_id, title AS text, 'http://n/' || article_id AS url, title FROM article WHERE title <> '' AND source_id IS NOT NULL",
    "fts_range": "SELECT article_id, event_ts FROM article WHERE substr(event_ts, 1, 10) = '2024-01-03'",
    "context_totals": """WITH RECURSIVE big AS (SELECT cluster_id, n AS member_count, sources FROM narr ORDER BY n DESC, cluster_id LIMIT 5),
        shown AS (SELECT cluster_id, article_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(event_ts, ''), article_id) AS k FROM member WHERE cluster_id IN (SELECT cluster_id FROM big)) WHERE k <= 10),
        para AS (SELECT s.cluster_id, sum(least(10, len(list_filter(string_split(a.text, chr(10)), lambda x: trim(x, ' ') <> '')))) AS paragraphs FROM shown s JOIN article a ON a.article_id = s.article_id GROUP BY 1)
        SELECT b.cluster_id, member_count, sources, CAST(paragraphs AS BIGINT) AS paragraphs, (SELECT count(DISTINCT article_id) FROM member WHERE cluster_id IN (SELECT cluster_id FROM big)) AS total_articles, (SELECT count(DISTINCT source_id) FROM shown) AS total_sources FROM big b LEFT JOIN para USING (cluster_id)""",
}
PLAIN = {
    "merge_associations": f"SELECT {_FIG} AS figment_id, least(a, b) AS a, greatest(a, b) AS b, confidence FROM (SELECT c_custkey - c_custkey % 5 AS a, CAST(c_nationkey + 1000000 AS BIGINT) AS b, max((c_custkey % 10) / 10.0)::DOUBLE AS confidence FROM customer GROUP BY 1, 2)",
    "merge_dedup_obs": "SELECT c_custkey AS id, c_custkey - c_custkey % 10 AS a, CASE WHEN c_custkey + 7 IN (SELECT c_custkey FROM customer) THEN c_custkey + 7 - (c_custkey + 7) % 10 ELSE c_custkey + 7 END AS b, c_mktsegment AS verdict FROM customer",
    "assoc_groups": "WITH RECURSIVE e AS (SELECT c_custkey AS p, c_custkey + 7 AS q FROM customer WHERE c_nationkey % 2 = 0 UNION SELECT c_custkey + 7, c_custkey FROM customer WHERE c_nationkey % 2 = 0), r AS (SELECT p, p AS q FROM e UNION SELECT r.p, e.q FROM r JOIN e ON r.q = e.p) SELECT p AS id, min(q) AS canonical FROM r GROUP BY 1",
    "assoc_expand": "SELECT 1::BIGINT AS id, 0 AS hop UNION ALL SELECT c_nationkey + 1000000, 1 FROM customer WHERE c_custkey = 1 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey <> 1 AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 1)",
    "assoc_propose": """WITH n AS (SELECT min(p_partkey) AS id, p_name AS norm, list_distinct(string_split(p_name, ' ')) AS w FROM part GROUP BY 2),
        p AS (SELECT x.id AS a, y.id AS b, 'what' AS role, round(len(list_intersect(x.w, y.w)) / CAST(greatest(len(x.w), len(y.w)) AS DOUBLE), 6) AS overlap, round(1 - levenshtein(x.norm, y.norm) / CAST(greatest(length(x.norm), length(y.norm)) AS DOUBLE), 6) AS edit FROM n x JOIN n y ON x.id < y.id)
        SELECT * FROM p WHERE overlap >= 0.5 OR edit >= 0.85""",
    "bfs_crawl": """WITH RECURSIVE link AS (SELECT 'r' || lpad(CAST(n_regionkey AS VARCHAR), 9, '0') AS src, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') AS dst FROM nation UNION ALL SELECT 'n' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0'), 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') FROM customer),
        both_ways AS (SELECT src, dst FROM link UNION SELECT dst, src FROM link),
        walk AS (SELECT node, 0 AS depth FROM (VALUES ('r000000000'), ('r000000003')) s(node) UNION SELECT dst, depth + 1 FROM walk JOIN both_ways ON src = node WHERE depth < 2 AND dst NOT LIKE '%7')
        SELECT node, min(depth) AS depth FROM walk GROUP BY 1 ORDER BY 2, 1 LIMIT 200""",
    "robots_filter": "SELECT page_id, url FROM pages WHERE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> '' AND NOT (length(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))) % 2 = 0 AND regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/en/'))",
    "search_source": "WITH r AS (SELECT url, page_id, page_id % 3 AS p FROM pages ORDER BY p, page_id LIMIT 1000) SELECT url, 'page ' || arg_min(page_id, p * 1000000 + page_id) AS title, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS source_id FROM r WHERE url LIKE 'http%' GROUP BY url",
    "json_recover": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS found FROM events",
    "upsert_merge": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0",
    "bucket_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0",
    "stream_ingest": f"SELECT url, max(length(t)) AS n_chars FROM (SELECT url, {_TEXT} AS t FROM pages) WHERE length(t) >= 40 AND NOT regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'msn\\.(com|co\\.uk|es|fr|it|de)') GROUP BY 1",
    "event_windows": "SELECT CAST(epoch(s) AS BIGINT) AS start_sec, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS s FROM events) GROUP BY 1, 2",
    "stream_gate": r"""WITH n AS (SELECT count(DISTINCT source) AS n FROM documents), ok AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents
        WHERE source IS NOT NULL AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 40)
        SELECT source AS source_id, 'http://x/' || doc_id AS url, length(text) AS n_chars FROM ok, n WHERE k <= 200 // n + 60 // n""",
    "event_sessions": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) < 21600 THEN 0 ELSE 1 END AS new FROM e),
        k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS part FROM g) SELECT min(s) AS start_sec, max(s) + 21600 AS end_sec, user_id, count(*) AS n FROM k GROUP BY user_id, part""",
    "range_filter": "WITH d AS (SELECT CAST(ts AS DATE) AS d FROM events) SELECT range, n FROM (SELECT 'today' AS range, count(*) AS n FROM d WHERE d >= DATE '2024-01-20' UNION ALL SELECT 'yesterday', count(*) FROM d WHERE d = DATE '2024-01-19' UNION ALL SELECT 'last_week', count(*) FROM d WHERE d >= DATE '2024-01-13' UNION ALL SELECT 'last_month', count(*) FROM d WHERE d >= DATE '2023-12-21' UNION ALL SELECT 'last_year', count(*) FROM d WHERE d >= DATE '2023-01-20' UNION ALL SELECT 'all', count(*) FROM d)",
}

QUERIES = {f.__name__: f for f in (
    role_match, intersect_all, intersect_any, intersect_min_trust, narrative_trust, narrative_entities, narrative_rows, narratives_incremental, narrative_sorts, narrative_ranges, narrative_screen, narrative_role_union, role_stories, merge_roles, merge_bridge, merge_associations, merge_dedup_obs, assoc_groups, assoc_expand, assoc_propose,
    trust_update, trust_board, trust_shift, bfs_crawl, robots_filter, page_main, page_metadata, label_hook, feed_parse, feed_budget, feed_budget_tight, feed_source, feed_stream, search_source, json_recover, registry_load, title_near_dup, upsert_merge, bucket_upsert, role_upsert, merge_relationships, lineage_rebuild, stream_ingest, stream_gate, event_windows, event_sessions,
    fts_search, fts_stemmed, fts_page, fts_upsert, fts_column, fts_range, range_filter, context_totals,
)}
