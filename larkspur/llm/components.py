"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, drop_written, split_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of edges (u, v), the smallest of each component left out, with the smallest node that it reaches.

    Each round joins every node's neighbours to the least of them; rounds grow with the logarithm of the
    longest path.  Nothing is collected: the loop compares a count and a sum of hashes.  The neighbours of
    a node of very many are spread over several tasks.  Null ends and loops link nothing; no edges give no
    rows.
    """
    e = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # large star: neighbours greater than a node go to its least
        near = split_join(both, least, "u", "v", "n", 2 * before[0])
        large = cut(near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "edges")
        # small star: a node and its lesser neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = split_join(large, low, "u", "v", "n", large.count()).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v"))
        after_edges = cut(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        drop_written(e.sparkSession, e, large)
        e, after = after_edges, _state(after_edges)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
