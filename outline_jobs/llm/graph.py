"""Connected components of large graphs, for groups of documents that resemble each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outline_jobs.llm.common import looked_up, written


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, root): each node but the roots themselves, with the smallest node of its component.

    Alternating large and small stars: each node's neighbours are hung below its smallest one, until all edges
    lead to roots. Sums are partial before every shuffle, edges of hubs stay where they are, and each star is written to the shared folder;
    nothing is collected but two numbers for each round. Self-loops and repeated edges do no harm.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, total = None, 2 * now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written between the stars: the second reads the first six times, so that one plan of both would hold it six times over in the driver.
        large = written(looked_up(both, least(both), ["a"], total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "edges")
        hung = least(large)
        small = looked_up(large, hung, ["a"], total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, total = state, 2 * state[0]


def least(edges: DataFrame) -> DataFrame:
    """a, its smallest neighbour m, and the number of its edges as _n."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
