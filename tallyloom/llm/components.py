"""Connected components of an undirected graph given by its links, in alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.core import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest node of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a")
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long), the component being its smallest node.

    Rounds of aggregates and joins on the nodes, each written in the shared folder; the number of rounds follows the
    logarithm of the longest path. Loops and repeated links do no harm.
    """
    clean = lambda df: df.filter("a <> b").distinct()
    current, last = written(clean(edges.select("a", "b")), "links"), None
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == last or state.n == 0:
            break
        last = state
        current = written(clean(_small_star(clean(_large_star(current)))), "links")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(roots)
