"""Articles, roles, narratives and their order in time."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import overlap
from newsloom.operators.graph import connected_components
from newsloom.storage import materialize, state, table

MIN_SHARED, DF_SHARE, DF_LEAST, MIN_SENTENCE, ENTITIES = 2, 0.2, 5, 12, 12
#: So many links are a few megabytes: one task joins them faster than rounds over tables would.
SMALL = 250_000
#: Roles of more articles are not joined with themselves where pairs are listed.
HOT = 256
#: What is written once: members and roles.
_MEMBERS: dict[tuple, DataFrame] = {}


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, with the time of the event of the same number."""
    docs, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    when = events.select(F.col("event_id").alias("article_id"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("event_ts"), F.unix_seconds(ts.cast("timestamp")).alias("event_sec"))
    rows = docs.select(F.col("doc_id").alias("article_id"), F.col("source").alias("source_id"), "lang", "text", T.title_of(F.col("text")).alias("title"))
    return rows.join(when, "article_id", "left")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(article_id, text)`` of the articles: what roles need of them."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")


def roles(arts: DataFrame) -> DataFrame:
    """``(article_id, norm, role_id)``: the distinct normalised sentences of each article as its roles.

    Texts are dealt by article before they are cut, so a scan of few splits does not hold the work up, and the distinct
    rows need no shuffle of their own.
    """
    rows = arts.select("article_id", "text").repartition("article_id").select("article_id", F.explode(F.split("text", r"[.\n]+")).alias("s"))
    rows = rows.select("article_id", F.trim("s").alias("s")).where(F.length("s") >= MIN_SENTENCE).select("article_id", T.normalize(F.col("s")).alias("norm"))
    rows = rows.where("norm <> ''").distinct()
    return rows.withColumn("role_id", T.role_id(F.lit("what"), F.col("norm")))


def frequent_cut(role_rows: DataFrame, n_articles: int) -> DataFrame:
    """Roles in at most a fifth of the articles (at least five)."""
    most = max(DF_LEAST, int(DF_SHARE * n_articles))
    rare = role_rows.groupBy("norm").agg(F.count("*").alias("df")).where(F.col("df").between(2, most))
    return role_rows.join(rare, "norm", "left_semi")


def shared_pairs(role_rows: DataFrame, n_articles: int, min_shared: int = MIN_SHARED) -> DataFrame:
    """``(a, b, n)``: pairs of articles with at least ``min_shared`` roles in common, a < b: as many as there are.

    Articles with the same set of roles are one class, of which the smallest meets others; the pairs of its members
    follow from its own. Roles of at most ``HOT`` articles are joined with themselves, which is in proportion to their
    number. Of more frequent ones each article carries its list into that join, and pairs that share such roles alone
    meet under each two of them: these are pairs to be listed, so no row is made for two articles that have one frequent
    role in common and nothing else. Roles are compared by 128-bit digests.
    """
    keys = frequent_cut(role_rows.select("article_id", F.unhex(F.md5("norm")).alias("norm")), n_articles).select("article_id", F.col("norm").alias("key"))
    keys = materialize(keys, "pair-roles", free=False)
    sets = keys.groupBy("article_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.hex("key"))), ","), 256).alias("same"), F.count("*").alias("k"))
    sets = materialize(sets.where(F.col("k") >= min_shared), "pair-sets", free=False)
    of = materialize(sets.join(sets.groupBy("same").agg(F.min("article_id").alias("first"), F.count("*").alias("size")), "same").select("article_id", "first", "k", "size"), "pair-classes", free=False)
    kept = keys.join(of.where("article_id = first").select("article_id"), "article_id", "left_semi")
    often = kept.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    kept = materialize(kept.join(often, "key"), "pair-first", free=False)

    hot = kept.where(F.col("df") > HOT).groupBy("article_id").agg(F.array_sort(F.collect_list("key")).alias("hot"))
    hot = materialize(hot, "pair-frequent", free=False)
    rare = kept.where(F.col("df") <= HOT).select("article_id", "key").join(hot, "article_id", "left")
    one, two = rare.toDF("a", "key", "hot_a"), rare.toDF("b", "key", "hot_b")
    shared = F.coalesce(F.size(F.array_intersect("hot_a", "hot_b")), F.lit(0))
    met = one.join(two, "key").where("a < b").select("a", "b", F.lit(1).alias("n"), F.when(F.col("hot_a").isNull() | F.col("hot_b").isNull(), 0).otherwise(shared).alias("h"))

    lists = hot.withColumn("list", F.md5(F.array_join(F.transform("hot", F.hex), ",")))
    each = lists.select("list", "hot").distinct().where(F.size("hot") >= min_shared)
    under = F.transform("hot", lambda x: F.array(x))
    if min_shared >= 2:
        under = F.flatten(F.transform("hot", lambda x, i: F.transform(F.slice("hot", i + 2, F.size("hot")), lambda y: F.array(x, y))))
    placed = each.select("list", "hot", F.explode(under).alias("under"))
    alike = placed.toDF("p", "hot_a", "under").join(placed.toDF("q", "hot_b", "under"), "under").where("p <= q").select("p", "q", F.size(F.array_intersect("hot_a", "hot_b")).alias("h")).distinct()
    ids = lists.select("article_id", "list")
    often = alike.where(F.col("h") >= min_shared).join(ids.toDF("x", "p"), "p").join(ids.toDF("y", "q"), "q").where("p < q AND x <> y OR x < y")
    often = often.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(0).alias("n"), "h")

    pairs = met.unionByName(often).groupBy("a", "b").agg((F.sum("n") + F.max("h")).alias("n")).where(F.col("n") >= min_shared)
    member = of.where("size > 1").select("article_id", "first")
    ends = lambda rows, end: rows.join(member.toDF("m", "f"), F.col(end) == F.col("f"), "left").withColumn(end, F.coalesce("m", end)).drop("m", "f")
    between = ends(ends(pairs, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")
    within = of.where("size > 1").select(F.col("article_id").alias("a"), "first", F.col("k").alias("n")).join(member.toDF("b", "first"), "first").where("a < b").select("a", "b", "n")
    return between.unionByName(within)


def linked(role_rows: DataFrame, n_articles: int) -> DataFrame:
    """``(a, b)``: links that make the components of ``shared_pairs``, from groups of equal articles to one of each.

    Articles with the same set of frequent roles, two at least, are one group: its members link to its smallest, and
    only that one meets others, by ``overlap.links``. So neither a text that is copied through a fifth of the corpus nor
    a role that unequal articles have in common makes a pair for each two of them. Roles are compared by 128-bit digests.
    """
    keys = role_rows.select("article_id", F.unhex(F.md5("norm")).alias("norm"))
    own = materialize(frequent_cut(keys, n_articles).select("article_id", F.col("norm").alias("key")), "linking-roles", free=False)
    return linked_by(own)


def linked_by(own: DataFrame) -> DataFrame:
    """``linked`` for roles (article_id, key) that are cut already, each role of an article once."""
    sets = own.groupBy("article_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.hex("key"))), ","), 256).alias("same"), F.count("*").alias("k"))
    sets = materialize(sets.where(F.col("k") >= MIN_SHARED), "role-sets", free=False)
    first = sets.groupBy("same").agg(F.min("article_id").alias("first"))
    copies = sets.join(first, "same").where("article_id <> first").select(F.col("first").alias("a"), F.col("article_id").alias("b"))
    kept = own.join(first.select(F.col("first").alias("article_id")), "article_id", "left_semi")
    pairs = overlap.links(kept, small=SMALL)
    return pairs.select("a", "b").unionByName(copies)


def stored_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``roles`` of all articles, written once for each application and state of the documents: texts are cut once."""
    key = (spark.sparkContext.applicationId, "roles", state(spark, sf_dir, "documents"))
    if key not in _MEMBERS:
        _MEMBERS[key] = materialize(roles(texts(spark, sf_dir)), "roles", free=False)
    return _MEMBERS[key]


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cluster_id, article_id, source_id, event_ts, event_sec, title, rn)``: narratives in order of time.

    A narrative is a connected component of the pairs; its id is its smallest article. Undated articles come last.
    The result is written once for each application and state of the input files, since many queries start from it.
    """
    key = (spark.sparkContext.applicationId, state(spark, sf_dir, "documents", "events"))
    if key not in _MEMBERS:
        arts = articles(spark, sf_dir)
        own = stored_roles(spark, sf_dir).select("article_id", "norm")
        label = connected_components(linked(own, table(spark, sf_dir, "documents").count()), small=SMALL).select(F.col("node").alias("article_id"), F.col("component").alias("cluster_id"))
        rows = arts.drop("text", "lang").join(label, "article_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "article_id"))
        order = Window.partitionBy("cluster_id").orderBy(F.col("event_sec").asc_nulls_last(), "article_id")
        _MEMBERS[key] = materialize(rows.withColumn("rn", F.row_number().over(order).cast("long")), "members")
    return _MEMBERS[key]


def narratives(member: DataFrame) -> DataFrame:
    """One row a narrative: its id by the members in order, its sources, first reporter and latest date."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rn", "article_id"))), lambda x: x["article_id"].cast("string"))
    out = member.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.array_join(ordered, "|").alias("members"), F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"),
        F.count_distinct("source_id").alias("n_sources"), F.max("event_ts").alias("latest"), F.min_by("article_id", "rn").alias("first_id"),
        F.min_by("source_id", "rn").alias("first_source"), F.max_by("article_id", "rn").alias("last_id"),
    )
    return out.withColumn("narrative_id", F.concat(F.lit("narrative:"), F.substring(F.sha1(F.col("members")), 1, 12)))


def frames(member: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(cluster_id, cos)`` of the first and the newest member of narratives of two or more; both need a vector.

    The newest member is the last in the order that puts undated ones last.
    """
    ends = member.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min_by("article_id", "rn").alias("f"), F.max_by("article_id", "rn").alias("l")).where("n >= 2")
    ends = ends.join(vectors.select(F.col("article_id").alias("f"), F.col("x").alias("x_f")), "f")
    ends = ends.join(vectors.select(F.col("article_id").alias("l"), F.col("x").alias("x_l")), "l")
    return ends.select("cluster_id", F.round(T.cosine(F.col("x_f"), F.col("x_l")), 6).alias("cos"))


def entities(member: DataFrame, role_rows: DataFrame, most: int = ENTITIES) -> DataFrame:
    """``(cluster_id, norm)``: the first roles of each narrative by text, those of three letters or more.

    They are among the first of its articles, so no more than those of an article are moved.
    """
    first = lambda rows, of: rows.withColumn("k", F.row_number().over(Window.partitionBy(of).orderBy("norm"))).where(F.col("k") <= most).drop("k")
    own = first(role_rows.where(F.length("norm") >= 3).select("article_id", "norm"), "article_id")
    named = own.join(member.select("article_id", "cluster_id"), "article_id").select("cluster_id", "norm").distinct()
    return first(named, "cluster_id")


def stories(member: DataFrame, role_rows: DataFrame, vectors: DataFrame, now_sec: int, frame: float) -> DataFrame:
    """Every narrative with all that is known of it: the columns of ``narratives`` and, besides,

    ``title`` and ``first_seen`` (of the first reporter), ``entities`` (the first twelve of three letters or more, by
    text), ``new_article_count`` (in the day before ``now_sec``), ``frame_shift`` with its score and note (null and false
    where a vector is missing) and ``derivatives``, how many articles came after the first.
    """
    extra = member.groupBy("cluster_id").agg(
        F.min_by("title", "rn").alias("title"), F.min("event_ts").alias("first_seen"),
        F.count_if(F.col("event_sec") >= now_sec - 86400).alias("new_article_count"), (F.count("*") - 1).alias("derivatives"),
    )
    named = entities(member, role_rows).groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("norm")), "|").alias("entities"))
    shift = frames(member, vectors).select("cluster_id", F.col("cos").alias("frame_shift_score"), (F.col("cos") < frame).alias("frame_shift"))
    out = narratives(member).join(extra, "cluster_id").join(named, "cluster_id", "left").join(shift, "cluster_id", "left")
    note = F.when(F.col("frame_shift"), F.format_string("Frame shift: first and newest article are %.3f alike", "frame_shift_score"))
    return out.withColumns({"entities": F.coalesce("entities", F.lit("")), "frame_shift": F.coalesce("frame_shift", F.lit(False)), "frame_shift_note": note})
