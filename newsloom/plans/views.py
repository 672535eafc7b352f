"""The relations that catalogue queries read: DataFrame operators on Spark, common table expressions on DuckDB."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import boundary, lineage
from newsloom.storage import table

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")
#: Pairs of vectors are reported on when their events are at most so far apart.
SIM_HOURS = 48


def trust_of(arts: DataFrame) -> DataFrame:
    k = F.regexp_extract("source_id", "([0-9]+)$", 1).cast("int")
    return arts.select("source_id").distinct().select("source_id", (F.lit(0.5) + F.lit(0.02) * (k % 20)).alias("trust"))


def _token(arts: DataFrame) -> DataFrame:
    """``(article_id, term, tf)``: words are counted in their article's own list; only texts of one id are put together."""
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = arts.groupBy("article_id").agg(F.flatten(F.transform(F.array_compact(F.collect_list("text")), words)).alias("words"))
    return rows.select("article_id", F.explode(T.runs(F.array_sort("words"))).alias("r")).select("article_id", F.col("r.item").alias("term"), F.col("r.n").alias("tf"))


def _sim(spark: SparkSession, sf_dir: str, labels: bool = True) -> DataFrame:
    """The pairs, with labels only where they are asked for: each row is copied between Python and Spark."""
    return boundary.near_in_time(boundary.dated(table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "events")), SIM_HOURS, labels=labels)


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Register the relations that ``sql`` names; each is a lazy plan."""
    arts = lineage.articles(spark, sf_dir)
    build = {
        "article": lambda: arts,
        "role": lambda: lineage.roles(lineage.texts(spark, sf_dir)),
        "pair": lambda: lineage.shared_pairs(lineage.stored_roles(spark, sf_dir), table(spark, sf_dir, "documents").count()),
        "member": lambda: lineage.members(spark, sf_dir),
        "narr": lambda: lineage.narratives(lineage.members(spark, sf_dir)),
        "trust": lambda: trust_of(arts),
        "token": lambda: _token(arts),
        "sim": lambda: _sim(spark, sf_dir, "label_" in sql),
        **{name: (lambda name=name: table(spark, sf_dir, name)) for name in RAW},
    }
    for name, make in build.items():
        if f" {name} " in sql.replace("\n", " ").replace(")", " ").replace(",", " ").replace("(", " ") + " ":
            make().createOrReplaceTempView(name)


def norm_sql(text: str) -> str:
    """The canonical form of an entity in DuckDB's SQL."""
    out = f"regexp_replace(trim(lower({text})), '^({'|'.join(T.HONORIFICS)})\\.?\\s*', '')"
    for pattern, by in (("''s\\b", ""), ("s''\\b", "s"), ("[^\\p{L}\\p{M}\\p{N}_\\s]", ""), ("\\s+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


_CTE = {
    "article": ((), r"""SELECT d.doc_id AS article_id, d.source AS source_id, d.lang, d.text, trim(regexp_split_to_array(d.text, '[.\n]')[1]) AS title,
        strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS event_ts, CAST(floor(epoch(e.ts)) AS BIGINT) AS event_sec FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id"""),
    "role": (("article",), rf"""SELECT DISTINCT article_id, norm, substr(sha256('role:what:' || norm), 1, 16) AS role_id FROM (
        SELECT article_id, {norm_sql('s')} AS norm
        FROM (SELECT article_id, trim(unnest(regexp_split_to_array(text, '[.\n]+'))) AS s FROM article) WHERE length(s) >= 12) WHERE norm <> ''"""),
    "pair": (("role", "article"), """SELECT x.article_id AS a, y.article_id AS b, count(*) AS n FROM role x JOIN role y ON x.norm = y.norm AND x.article_id < y.article_id
        WHERE x.norm IN (SELECT norm FROM role GROUP BY norm HAVING count(*) <= greatest(5, (SELECT floor(0.2 * count(*)) FROM article))) GROUP BY 1, 2 HAVING count(*) >= 2"""),
    "reach": (("pair", "article"), """SELECT article_id AS p, article_id AS q FROM article UNION
        SELECT reach.p, e.q FROM reach JOIN (SELECT a AS p, b AS q FROM pair UNION ALL SELECT b, a FROM pair) e ON reach.q = e.p"""),
    "member": (("reach", "article"), """SELECT cluster_id, article_id, source_id, event_ts, event_sec, title, row_number() OVER (PARTITION BY cluster_id ORDER BY event_sec ASC NULLS LAST, article_id) AS rn
        FROM (SELECT p AS article_id, min(q) AS cluster_id FROM reach GROUP BY 1) JOIN article USING (article_id)"""),
    "narr": (("member",), """SELECT *, 'narrative:' || substr(sha1(members), 1, 12) AS narrative_id FROM (SELECT cluster_id, count(*) AS n, string_agg(CAST(article_id AS VARCHAR), '|' ORDER BY rn) AS members,
        array_to_string(list_sort(list_distinct(list(source_id))), ',') AS sources, count(DISTINCT source_id) AS n_sources, max(event_ts) AS latest, min_by(article_id, rn) AS first_id,
        min_by(source_id, rn) AS first_source, max_by(article_id, rn) AS last_id FROM member GROUP BY cluster_id)"""),
    "trust": (("article",), "SELECT DISTINCT source_id, CAST(0.5 AS DOUBLE) + CAST(0.02 AS DOUBLE) * (CAST(regexp_extract(source_id, '([0-9]+)$', 1) AS INT) % 20) AS trust FROM article"),
    "token": (("article",), r"SELECT article_id, term, count(*) AS tf FROM (SELECT article_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM article) GROUP BY 1, 2"),
    "dated": ((), "SELECT v.vec_id AS id, v.label, CAST(v.embedding AS DOUBLE[]) AS x, CAST(floor(epoch(e.ts)) AS BIGINT) AS sec FROM embeddings v JOIN events e ON v.vec_id = e.event_id"),
    "sim": (("dated",), """SELECT p.id AS a, q.id AS b, p.label AS label_a, q.label AS label_b, round(list_dot_product(p.x, q.x) / (sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x)) + 1e-10), 6) AS cos
        FROM dated p JOIN dated q ON p.id < q.id AND abs(p.sec - q.sec) <= 172800"""),
}


def oracle(sql: str) -> str:
    """The query with the common table expressions that it needs in front."""
    padded = sql.replace("\n", " ").replace(")", " ").replace(",", " ").replace("(", " ") + " "
    need: list[str] = []

    def add(name: str) -> None:
        for other in _CTE[name][0]:
            add(other)
        if name not in need:
            need.append(name)

    for name in _CTE:
        if f" {name} " in padded:
            add(name)
    ctes = ", ".join(f"{n} AS ({_CTE[n][1]})" for n in need)
    rest = sql.removeprefix("WITH RECURSIVE ")
    return (f"WITH RECURSIVE {ctes}{' ' if rest == sql else ', '}{rest}") if need else sql
