"""The catalogue: standard SQL over the views, the same text for Spark and for the oracle.

What differs between the engines - scalar functions, clustering, order in time, similarity - is in ``views``, once as
DataFrame operators and once as plain SQL. "Now" is always given: ASOF.
"""

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans import engine, entries
from newsloom.plans.views import oracle, views

ASOF, ASOF_SEC = "2024-01-31 00:00:00", 1706659200
TRUSTED = "SELECT m.cluster_id, round(avg(coalesce(t.trust, 0.5)), 6) AS trust FROM (SELECT DISTINCT cluster_id, source_id FROM member ) m LEFT JOIN trust t ON m.source_id = t.source_id GROUP BY m.cluster_id"
DAYS = f"CASE WHEN latest IS NULL THEN 9999 ELSE greatest(0, CAST(floor(({ASOF_SEC} - last_sec) / 86400.0) AS INT)) END"
RANKED = f"SELECT n.cluster_id, n.n_sources, n.latest, t.trust, {DAYS} AS days FROM narr n JOIN ( {TRUSTED} ) t ON n.cluster_id = t.cluster_id JOIN (SELECT cluster_id, max(event_sec) AS last_sec FROM member GROUP BY cluster_id) s ON n.cluster_id = s.cluster_id"
REMAP = "SELECT p_partkey AS old_id, p_partkey - p_partkey % 10 AS new_id FROM part "
EDGE = "SELECT c_custkey AS a, c_nationkey + 1000000 AS b FROM customer "
SWEEP = "SELECT th, count(CASE WHEN cos >= th AND label_a = label_b THEN 1 END) AS tp, count(CASE WHEN cos >= th AND label_a <> label_b THEN 1 END) AS fp, count(CASE WHEN cos < th AND label_a = label_b THEN 1 END) AS fn FROM sim CROSS JOIN (SELECT CAST(0.1 AS DOUBLE) AS th UNION ALL SELECT CAST(0.2 AS DOUBLE) UNION ALL SELECT CAST(0.3 AS DOUBLE)) x GROUP BY th"

SQL = {
    # Scans, lookups, filters
    "article_lookup": "SELECT article_id, source_id, title FROM article WHERE article_id = 7",
    "articles_by_source": "SELECT source_id, count(*) AS n FROM article WHERE source_id <> '' GROUP BY source_id",
    "source_page": "SELECT article_id, title, event_ts FROM article WHERE source_id = 'src3'",
    "source_coverage": "SELECT source_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS BIGINT) AS longest FROM article GROUP BY source_id",
    "ingest_stats": "SELECT count(*) AS articles, count(DISTINCT source_id) AS sources, min(event_ts) AS first_seen FROM article ",
    "front_page": "SELECT article_id, source_id, event_ts FROM article ORDER BY event_ts DESC NULLS LAST, article_id LIMIT 30",
    "title_fallback": "SELECT article_id, coalesce(nullif(title, ''), substring(text, 1, 80)) AS title FROM article ",
    "newspaper_articles": "SELECT article_id, source_id, coalesce(nullif(title, ''), substring(text, 1, 80)) AS title, event_ts, substring(event_ts, 1, 10) AS day FROM article ",
    "pending_summaries": "SELECT a.article_id FROM article a LEFT JOIN labels l ON a.article_id = l.doc_id WHERE l.doc_id IS NULL ORDER BY a.article_id LIMIT 10",
    "relative_age": f"SELECT article_id, CASE WHEN event_sec IS NULL THEN '' WHEN {ASOF_SEC} - event_sec < 3600 THEN concat(CAST(CAST(floor(({ASOF_SEC} - event_sec) / 60.0) AS BIGINT) AS STRING), ' min ago') WHEN {ASOF_SEC} - event_sec < 86400 THEN concat(CAST(CAST(floor(({ASOF_SEC} - event_sec) / 3600.0) AS BIGINT) AS STRING), ' hr ago') ELSE concat(CAST(CAST(floor(({ASOF_SEC} - event_sec) / 86400.0) AS BIGINT) AS STRING), ' days ago') END AS age FROM article ",
    "feed_budget": "SELECT article_id, source_id FROM (SELECT article_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY article_id) AS k FROM article ) x WHERE k <= 5",
    "registry_lookup": "SELECT a.article_id, coalesce(t.trust, 0.3) AS base_trust FROM article a LEFT JOIN (SELECT source_id, trust FROM trust WHERE source_id <> 'src1') t ON a.source_id = t.source_id",
    "stats": "SELECT (SELECT count(*) FROM article ) AS articles, (SELECT count(*) FROM role ) AS role_links, (SELECT count(*) FROM narr ) AS narratives, (SELECT max(event_ts) FROM article ) AS last_seen",
    # Roles
    "article_roles": "SELECT article_id, role_id FROM role ",
    "provenance": "SELECT r.article_id, r.role_id, a.source_id, a.event_ts, a.title FROM role r JOIN article a ON r.article_id = a.article_id",
    "role_dim": "SELECT role_id, norm, min(article_id) AS first_article_id, count(*) AS reference_count FROM role GROUP BY role_id, norm",
    "role_facets": "SELECT norm, count(*) AS reference_count, min(article_id) AS first_article_id FROM role GROUP BY norm",
    "role_df_filter": "SELECT norm, count(*) AS df FROM role GROUP BY norm HAVING count(*) <= (SELECT greatest(5, CAST(floor(0.2 * count(*)) AS INT)) FROM article )",
    "self_ref_filter": "SELECT r.article_id, r.norm FROM role r JOIN article a ON r.article_id = a.article_id WHERE position(trim(lower(replace(replace(a.source_id, '_', ' '), '-', ' '))) IN r.norm) = 0",
    "shared_role_pairs": "SELECT a, b, n FROM pair ",
    # Narratives
    "narrative_clusters": "SELECT cluster_id, count(*) AS size, count(DISTINCT source_id) AS n_sources FROM member GROUP BY cluster_id",
    "narratives": "SELECT narrative_id, cluster_id, n, members, sources, latest, first_id, first_source FROM narr ",
    "lineage": "SELECT n.narrative_id, m.article_id, m.rn, n.first_id, n.first_source, n.latest FROM narr n JOIN member m ON n.cluster_id = m.cluster_id",
    "first_reporter": "SELECT cluster_id, article_id, source_id FROM member WHERE rn = 1",
    "derivatives": "SELECT concat('deriv:', CAST(f.article_id AS STRING), ':', CAST(m.article_id AS STRING)) AS derivative_id, f.article_id AS original, m.article_id AS derivative FROM member m JOIN member f ON m.cluster_id = f.cluster_id AND f.rn = 1 WHERE m.rn > 1",
    "top_stories": "SELECT cluster_id, n, latest FROM narr ORDER BY coalesce(latest, '9999') DESC, cluster_id LIMIT 30",
    "narrative_new_count": "SELECT cluster_id, count(CASE WHEN event_ts >= '2024-01-30 00:00:00' THEN 1 END) AS new_article_count FROM member GROUP BY cluster_id",
    "narrative_entities": "SELECT cluster_id, norm FROM (SELECT cluster_id, norm, row_number() OVER (PARTITION BY cluster_id ORDER BY norm) AS k FROM (SELECT DISTINCT m.cluster_id, r.norm FROM member m JOIN role r ON m.article_id = r.article_id WHERE length(r.norm) >= 3) x) y WHERE k <= 12",
    "narrative_page": "SELECT m.article_id, m.source_id, m.rn FROM member m JOIN (SELECT cluster_id FROM narr ORDER BY n DESC, cluster_id LIMIT 1) b ON m.cluster_id = b.cluster_id",
    "article_related": "SELECT a.article_id, b.article_id AS related_id FROM member a JOIN member b ON a.cluster_id = b.cluster_id AND a.article_id <> b.article_id WHERE a.article_id = (SELECT first_id FROM narr ORDER BY n DESC, cluster_id LIMIT 1)",
    "narrative_source_counts": "SELECT cluster_id, source_id, count(*) AS n FROM member GROUP BY cluster_id, source_id",
    "narrative_roles": "SELECT DISTINCT m.cluster_id, r.role_id FROM member m JOIN role r ON m.article_id = r.article_id",
    "role_story_link": "SELECT d.role_id, m.cluster_id FROM (SELECT role_id, min(article_id) AS article_id FROM role GROUP BY role_id) d JOIN member m ON d.article_id = m.article_id",
    "rank_trust": f"SELECT cluster_id, trust FROM ( {RANKED} ) r ORDER BY trust DESC, cluster_id LIMIT 20",
    "rank_recency": f"SELECT cluster_id, days FROM ( {RANKED} ) r ORDER BY days, cluster_id LIMIT 20",
    "rank_sources": f"SELECT cluster_id, n_sources FROM ( {RANKED} ) r ORDER BY n_sources DESC, cluster_id LIMIT 20",
    "rank_trust_recency": f"SELECT cluster_id, round(0.6 * trust + 0.4 / (1 + days), 6) AS rank_score FROM ( {RANKED} ) r ORDER BY round(0.6 * trust + 0.4 / (1 + days), 6) DESC, cluster_id LIMIT 20",
    "narratives_page": "SELECT cluster_id, n, latest FROM narr ORDER BY latest DESC NULLS LAST, cluster_id LIMIT 20 OFFSET 20",
    "ui_filter": "SELECT cluster_id, n_sources, latest FROM narr WHERE n_sources >= 2 AND latest >= '2024-01-02' AND position('src1' IN sources) > 0",
    "brief_selection": "SELECT first_id AS article_id FROM narr ORDER BY coalesce(latest, '9999') DESC, cluster_id LIMIT 8",
    "source_agenda": "SELECT source_id, count(CASE WHEN source_id = first_source THEN 1 END) AS led, count(CASE WHEN source_id <> first_source THEN 1 END) AS echoed FROM (SELECT DISTINCT m.cluster_id, m.source_id, n.first_source FROM member m JOIN narr n ON m.cluster_id = n.cluster_id) x GROUP BY source_id",
    "context_topn": "SELECT cluster_id, article_id FROM (SELECT cluster_id, article_id, row_number() OVER (PARTITION BY cluster_id ORDER BY event_ts DESC NULLS LAST, article_id) AS k FROM member ) x WHERE k <= 10",
    # Trust
    "source_trusts": "SELECT source_id, trust FROM trust ",
    # Full text
    "fts_index": "SELECT article_id, term, tf FROM token ",
    "fts_count": "SELECT count(DISTINCT article_id) AS total FROM token WHERE term IN ('the', 'license')",
    "fts_browse": "SELECT article_id, event_ts FROM article ORDER BY event_ts DESC NULLS LAST, article_id LIMIT 20 OFFSET 20",
    # Vectors and thresholds
    "cosine": "SELECT a, b, cos FROM sim ",
    "boundary_stats": "SELECT label_a = label_b AS verdict, count(*) AS n, round(avg(cos), 5) AS mean, round(median(cos), 5) AS median, round(stddev_samp(cos), 5) AS stdev, min(cos) AS low, max(cos) AS high FROM sim GROUP BY label_a = label_b",
    "boundary_source_pairs": "SELECT least(label_a, label_b) AS one, greatest(label_a, label_b) AS two, count(*) AS n FROM sim GROUP BY least(label_a, label_b), greatest(label_a, label_b)",
    "boundary_origins": "SELECT label_a AS origin, count(*) AS n FROM sim GROUP BY label_a",
    "threshold_quality": f"SELECT th, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS prec, round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall FROM ( {SWEEP} ) s",
    "threshold_best": f"SELECT th, round(2.0 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM ( {SWEEP} ) s ORDER BY round(2.0 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) DESC, th LIMIT 1",
    # Identity: one remap joined into every table that refers to it
    "merge_relationships": f"SELECT least(x.new_id, y.new_id) AS a, greatest(x.new_id, y.new_id) AS b, CAST(count(*) AS BIGINT) AS weight FROM lineitem l JOIN lineitem k ON l.l_orderkey = k.l_orderkey AND l.l_partkey < k.l_partkey JOIN ( {REMAP} ) x ON l.l_partkey = x.old_id JOIN ( {REMAP} ) y ON k.l_partkey = y.old_id WHERE x.new_id <> y.new_id GROUP BY least(x.new_id, y.new_id), greatest(x.new_id, y.new_id)",
    # Sinks, sets, graph export
    "url_dedup": "SELECT p.page_id, p.url FROM pages p LEFT JOIN (SELECT url AS seen FROM pages WHERE page_id % 3 = 0) s ON p.url = s.seen WHERE s.seen IS NULL",
    "search_results": "SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS k FROM pages WHERE url LIKE 'http%') x WHERE k = 1",
    "feed_overlay": """SELECT coalesce(r.source_id, l.source_id) AS source_id, coalesce(r.feed, l.feed) AS feed
        FROM (SELECT source_id, 'http://cfg/?first=' || min(article_id) AS feed FROM article GROUP BY source_id) l
        FULL JOIN (SELECT trim(substr(g, 1, instr(g, '=') - 1)) AS source_id, trim(substr(g, instr(g, '=') + 1)) AS feed
            FROM (SELECT source_id || CASE WHEN min(article_id) % 2 = 0 THEN '' ELSE '_new' END || '= http://cli/?last=' || max(article_id) AS g FROM article GROUP BY source_id) x WHERE instr(g, '=') > 0) r
        ON l.source_id = r.source_id""",
    "seed_union": "SELECT url FROM pages UNION ALL SELECT 'http://example.com/' AS url",
    "graph_nodes": "SELECT concat('a', CAST(article_id AS STRING)) AS id, 'article' AS kind FROM article UNION ALL SELECT DISTINCT role_id AS id, 'role' AS kind FROM role UNION ALL SELECT DISTINCT source_id AS id, 'source' AS kind FROM article ",
    "graph_edges": "SELECT concat('a', CAST(article_id AS STRING)) AS src, role_id AS dst, 'child' AS kind FROM role UNION ALL SELECT concat('a', CAST(article_id AS STRING)) AS src, source_id AS dst, 'source' AS kind FROM article ",
}


def run(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, sql)
    return spark.sql(sql)


QUERIES = {name: partial(run, sql) for name, sql in SQL.items()} | entries.QUERIES | engine.QUERIES
ORACLE_SQL = {name: oracle(sql) for name, sql in (SQL | entries.OVER_VIEWS | engine.OVER_VIEWS).items()} | entries.PLAIN | engine.PLAIN
