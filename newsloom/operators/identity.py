"""Identity of roles: which may be the same, groups of those that are, and one map that merges them everywhere.

A merge is a DataFrame ``(old_id, new_id)``. ``resolve`` drops the entries that mean nothing; every table that refers
to roles is rewritten by a left join with it, so that a merge that is repeated changes nothing.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.boundary import near_in_time
from newsloom.operators.graph import connected_components

OVERLAP, EDIT, TOGETHER, COSINE = 0.5, 0.85, 3, 0.9
#: Percent of the longer text that may be edited, and the letters of one of its pieces.
EDITS, PIECE = 15, 3


def _rarest(rows: DataFrame, items: Column, needed: Callable[[Column], Column]) -> DataFrame:
    """``(id, role, key)``: of each row's items the rarest in its role, as many as ``needed`` says of their number."""
    each = rows.select("id", "role", F.explode(items).alias("key"))
    df = each.groupBy("role", "key").agg(F.count("*").alias("df"))
    sorted_keys = F.array_sort(F.collect_list(F.struct("df", "key")))
    ranked = each.join(df, ["role", "key"]).groupBy("id", "role").agg(F.transform(sorted_keys, lambda x: x["key"]).alias("keys"))
    return ranked.select("id", "role", F.explode(F.slice("keys", F.lit(1), needed(F.size("keys")))).alias("key"))


def _pieces(text: Column) -> Column:
    """All runs of three letters of a text with its ends marked, each with the number of its occurrence."""
    marked = F.concat(F.lit("\x02\x02"), text, F.lit("\x03\x03"))
    runs = F.transform(F.sequence(F.lit(1), F.length(marked) - (PIECE - 1)), lambda i: F.substr(marked, i, F.lit(PIECE)))
    sorted_runs = F.array_sort(runs)
    return F.transform(sorted_runs, lambda x, i: F.concat(x, (i - F.array_position(sorted_runs, x)).cast("string")))


def _met(keyed: DataFrame) -> DataFrame:
    left, right = keyed.select("role", "key", F.col("id").alias("a")), keyed.select("role", "key", F.col("id").alias("b"))
    return left.join(right, ["role", "key"]).where("a < b").select("a", "b").distinct()


def propose(roles: DataFrame, together: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """``(a, b, role, overlap, edit, seen_together)``: pairs of one role, a < b, that may be the same.

    Of ``roles`` (id, role, norm), an id being one row; blank norms are none. A pair shares half the words of the longer
    text, or is 0.85 alike by edit distance, or - ``together`` (a, b, n) counts common articles - shares any word and was
    seen in three or more, or has vectors (``vectors``: id, x) with a cosine of 0.9 or more, which then is a column too.

    No such pair is lost. Half of the words shared means that one of a text's rarest words is, all but half of them and
    one. Edits of 15 percent of the longer text change three pieces of three letters each, so two texts that near share
    one of the rarest pieces, three for each edit and three more. Pairs seen together are looked at as they are, and
    vectors meet in blocks.
    """
    rows = roles.select("id", "role", "norm", F.array_distinct(F.split("norm", " ")).alias("words")).where("norm <> ''")
    by_word = _rarest(rows, F.col("words"), lambda n: n - F.ceil(n * OVERLAP).cast("int") + 1)
    # A partner that is one letter longer may take one edit more: three pieces for it, less the letter's own.
    by_piece = _rarest(rows, _pieces(F.col("norm")), lambda n: (F.lit(PIECE) * F.floor((n - 2) * EDITS / 100) + PIECE).cast("int"))
    pairs = _met(by_word).unionByName(_met(by_piece))
    if together is not None:
        pairs = pairs.unionByName(together.where(F.col("n") >= TOGETHER).select("a", "b"))
    near = None
    if vectors is not None:
        at_once = vectors.select("id", F.lit(0).alias("label"), F.lit(0).cast("long").alias("sec"), "x")
        near = near_in_time(at_once, 1, COSINE).select("a", "b", F.col("cos").alias("cosine"))
        pairs = pairs.unionByName(near.select("a", "b"))
    side = lambda s: rows.select(F.col("id").alias(s), F.col("role").alias(f"role_{s}"), F.col("norm").alias(f"norm_{s}"), F.col("words").alias(f"words_{s}"))
    pairs = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where("role_a = role_b")
    overlap = F.size(F.array_intersect("words_a", "words_b")) / F.greatest(F.size("words_a"), F.size("words_b"))
    edit = 1 - F.levenshtein("norm_a", "norm_b") / F.greatest(F.length("norm_a"), F.length("norm_b"))
    pairs = pairs.select("a", "b", F.col("role_a").alias("role"), F.round(overlap, 6).alias("overlap"), F.round(edit, 6).alias("edit"))
    alike = (F.col("overlap") >= OVERLAP) | (F.col("edit") >= EDIT)
    if together is None:
        pairs = pairs.withColumn("seen_together", F.lit(0).cast("long"))
    else:
        pairs = pairs.join(together.select("a", "b", F.col("n").alias("seen_together")), ["a", "b"], "left").fillna(0, ["seen_together"])
        alike = alike | ((F.col("seen_together") >= TOGETHER) & (F.col("overlap") > 0))
    if near is not None:
        pairs = pairs.join(near, ["a", "b"], "left")
        alike = alike | F.col("cosine").isNotNull()
    return pairs.where(alike)


def groups(links: DataFrame) -> DataFrame:
    """``(canonical, id)``: the components of association links (a, b) of any length; the smallest id is canonical."""
    return connected_components(links).select(F.col("component").alias("canonical"), F.col("node").alias("id"))


def expand(links: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """``(id, hop)``: what is at most so many links away from the ids of ``start``, these included."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reached, edge = start.select("id", F.lit(0).alias("hop")), start.select("id")
    for hop in range(1, hops + 1):
        edge = edge.join(both, edge["id"] == both["a"]).select(F.col("b").alias("id")).distinct()
        reached = reached.unionByName(edge.withColumn("hop", F.lit(hop)))
    return reached.groupBy("id").agg(F.min("hop").alias("hop"))


def resolve(merges: DataFrame, roles: DataFrame, id_col: str = "role_id") -> DataFrame:
    """The entries of ``merges`` (old_id, new_id) that do something: both ids are known roles, and they differ.

    Where an id is to go to several, the smallest takes it; chains end at their last link by repeating the merge.
    """
    known = roles.select(F.col(id_col).alias("k")).distinct()
    rows = merges.where("old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    return rows.join(known, rows["new_id"] == known["k"], "left_semi").join(known, rows["old_id"] == known["k"], "left_semi")


def rewrite(rows: DataFrame, column: str, remap: DataFrame) -> DataFrame:
    """``rows`` with the ids of one column replaced; others, and nulls, stay."""
    known = remap.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    out = rows.join(known, F.col(column) == F.col("_old"), "left")
    return out.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def merge_roles(roles: DataFrame, remap: DataFrame) -> DataFrame:
    """Roles (role_id, text, references, merged_from) after the merge, with ``reference_count`` and ``is_association``.

    References are united without repeats, in order; ``merged_from`` takes up the ids that are gone. The text is the
    kept role's own.
    """
    was = roles.withColumn("was", F.col("role_id"))
    rows = rewrite(was, "role_id", remap).withColumn("gone", F.col("was") != F.col("role_id"))
    own = F.struct(F.col("gone"), F.col("was"))
    out = rows.groupBy("role_id").agg(
        F.min_by("text", own).alias("text"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("gone", "was", "references"))), lambda x: x["references"]))).alias("references"),
        F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list("merged_from")), F.array_compact(F.collect_list(F.when(F.col("gone"), F.col("was"))))))).alias("merged_from"),
    )
    return out.withColumns({"reference_count": F.size("references").cast("long"), "is_association": F.size("merged_from") > 0})


def merge_lists(rows: DataFrame, id_col: str, column: str, remap: DataFrame) -> DataFrame:
    """Rows whose array of ids is rewritten in place: order stays, an id that comes twice is kept once, first."""
    each = rows.select(id_col, F.posexplode_outer(column).alias("_at", "_id"))
    new = rewrite(each, "_id", remap).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", "_id"))).alias("_all"))
    ids = F.array_distinct(F.array_compact(F.transform("_all", lambda x: x["_id"])))
    return rows.drop(column).join(new.select(id_col, ids.alias(column)), id_col)


def _edge_id(kind: str, a: Column, b: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(kind), F.least(a, b).cast("string"), F.greatest(a, b).cast("string")), 256), 1, 16)


def merge_edges(rels: DataFrame, remap: DataFrame, kind: str = "rel") -> DataFrame:
    """``(figment_id, a, b, weight)``: both ends replaced, weights of edges that meet summed, loops dropped."""
    rows = rewrite(rewrite(rels, "a", remap), "b", remap).where("a <> b")
    rows = rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
    return rows.select(_edge_id(kind, F.col("a"), F.col("b")).alias("figment_id"), "a", "b", "weight")


def merge_links(links: DataFrame, remap: DataFrame, role: str) -> DataFrame:
    """``(figment_id, a, b, confidence)``: association links with both ends replaced; of links that meet the surest stays."""
    rows = rewrite(rewrite(links, "a", remap), "b", remap).where("a <> b")
    rows = rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("confidence").alias("confidence"))
    return rows.select(_edge_id(f"assoc:{role}", F.col("a"), F.col("b")).alias("figment_id"), "a", "b", "confidence")


def merge_observations(rows: DataFrame, remap: DataFrame) -> DataFrame:
    """Observations (a, b, ...) with both ends replaced; the two may become equal, and every row stays."""
    return rewrite(rewrite(rows, "a", remap), "b", remap)
