"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwright.llm.common import stored


def _hung_on_min(pairs: DataFrame) -> DataFrame:
    """Every row (u, v) with ``m``, the least of u and its partners; the minimum combines map-side, no partner list is built."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs["u"] == least["__u"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hung_on_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    found = _hung_on_min(edges)
    return found.select("u", F.col("m").alias("v")).union(found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node with an edge (u, v), the least node it can reach.

    Loops and repeated edges are allowed, an edge with a null end is no edge, no
    edges give no rows. The number of rounds grows with the logarithm of a
    component's size; each is written to the scratch folder.
    """
    loops = edges.where("u = v")
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        last, mark = mark, _mark(edges)
        if last == mark:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).union(loops.select("u", "u"))
    return nodes.groupBy("node").agg(F.min("root").alias("root"))
