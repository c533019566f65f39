"""Connected components of an edge table by alternating star contraction.

Large-star links every larger neighbour of a vertex to its smallest neighbour,
small-star every smaller-or-equal one; after a logarithmic number of rounds
each vertex hangs on the smallest vertex of its component. A round is two
partial aggregates and two joins; nothing is gathered per vertex, so a vertex
with very many edges costs no task more than its share (the skewed join side is
split by Spark). Every round's edges are checkpointed to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.ragged import written


def star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on rows (a, b), a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (a, b): every vertex that is not its component's smallest, with
    that smallest vertex. ``edges`` has two columns of one orderable type."""
    left, right = edges.columns
    edges = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a > b").distinct()
    edges, seen = written(edges, "edges"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            return edges
        seen, edges = now, written(star(edges), "edges")
