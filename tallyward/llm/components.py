"""Connected components of a graph given by edges, by alternating star contraction.

Each round links larger neighbours, then smaller ones, to the smallest neighbour known;
rounds grow with the logarithm of the size. Every round is written to the shared folder,
so lineage stays short; nothing is collected but a count. The rounds end as soon as the
edges are stars, so no round is run only to see that nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rounds after which something must be wrong; partial groups are never returned.
ROUNDS = 60


def _stars(e: DataFrame) -> bool:
    """Each node of edges (u, v), v < u, has one edge up, or only edges down: then v is the smallest node that u reaches."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x"))
    nodes = ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.count(F.lit(1)).alias("n"))
    return nodes.where("up > 0 and n > 1").count() == 0


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b: long); the label is the smallest node reachable."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    for _ in range(ROUNDS):
        if _stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        star = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(star, "stars")
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
