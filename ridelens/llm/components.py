"""Connected components of a link table by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node around it."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"),
                                                                       F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below are linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    linked = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; root is the least node reachable.

    Both stars only ever compare a node with its neighbours' minimum (a map-side
    aggregate and an equi-join), so a node with very many links is no single
    task; the number of rounds grows with the logarithm of the longest path.
    """
    edges = cut_lineage(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)).where("a <> b").distinct())
        # equal count and digest of the links: nothing moved
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select("b", "b").distinct())
