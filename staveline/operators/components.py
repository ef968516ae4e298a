"""Connected components by alternating star contractions.

Every round rewires each edge to the smallest neighbour (first towards larger
nodes, then towards smaller ones), which halves path lengths. All steps are
partial aggregations and equi-joins, so that a node with very many neighbours
is pre-aggregated and its join side is split by adaptive execution. Rounds are
logarithmic in the diameter; each is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveline.sources.scratch import discard, materialize


#: Edges in a file; rewiring never adds edges, so that the count before bounds the count after.
ROWS_A_FILE = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(low.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge list; the component is its smallest node.

    ``left`` and ``right`` are integer columns. Self-loops keep their node, null
    ends are ignored, repeated and reversed edges count once, an empty edge list
    gives an empty result; other columns of the input are not read.
    """
    ends = edges.select(F.col(left).cast("long").alias("x"), F.col(right).cast("long").alias("y")).dropna()
    loops = ends.filter("x = y").select(F.col("x").alias("node")).distinct()
    star = materialize(
        ends.filter("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges"
    )
    seen = _fingerprint(star)
    while seen[0]:
        step = materialize(_small_star(_large_star(star)), "edges", files=1 + seen[0] // ROWS_A_FILE)
        now = _fingerprint(step)
        discard(star)
        star = step
        if now == seen:
            break
        seen = now
    members = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select("node", F.col("node").alias("component"))
    return members.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
