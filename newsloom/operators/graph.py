"""Connected components on DataFrames, by alternating large-star and small-star steps.

The method is that of Kiveris et al. (SoCC 2014). Every step is one partial aggregation and one equi-join whose
two sides are plain shuffles, so adaptive execution may split a node that holds a large share of all edges.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from newsloom.storage import discard, materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())


def _star(moves: DataFrame, low: DataFrame) -> DataFrame:
    return moves.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; the minima are written so that both sides of each join are plain shuffles."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "large", free=False)
    large = materialize(_canonical(_star(both.where("b > a"), low)), "star", free=False)
    discard(edges, low)
    low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "small", free=False)
    small = materialize(_canonical(_star(large, low).unionByName(low.select("a", F.col("m").alias("b")))), "star", free=False)
    discard(large, low)
    return small


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _one_task(edges: DataFrame) -> DataFrame:
    """The components of edges that are known to be few, by union-find in one task on an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((root(x), root(y)))
                up[high] = low
        if up:
            nodes = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["node", "component"])

    node = edges.schema["a"].dataType
    return edges.select("a", "b").coalesce(1).mapInArrow(run, StructType([StructField("node", node), StructField("component", node)]))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, small: int = 0) -> DataFrame:
    """``(node, component)`` for every node on an edge; the component is its smallest node.

    Where at most ``small`` edges are left, one task finishes them; the result is the same.
    Edges with a null end and self-loops are left out (a node with only a self-loop is not returned). Duplicate and
    reversed edges count once. No edges: an empty result. Ends may be numbers or strings, ordered as Spark orders them.
    """
    now = materialize(_canonical(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()), "edges")
    seen = _fingerprint(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        if seen[0] <= small:
            return _one_task(now)
        now = _round(now)
        mark = _fingerprint(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
