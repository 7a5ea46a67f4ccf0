"""Connected components of an edge list, entirely on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch


def _order(node: Column | str, seed: int) -> Column:
    """A random order of nodes, another for every second round; the node itself breaks ties."""
    node = F.col(node) if isinstance(node, str) else node
    return F.struct(F.xxhash64(node, F.lit(seed)).alias("rank"), node.alias("node"))


def _pointers(edges: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """(node, to): every node with an edge and the local minimum of the order that it leads to.

    A node points to its first neighbour if that is before itself (a minimum that is partially aggregated, so a node of
    very many neighbours isn't gathered anywhere). Pointers are followed to their ends by doubling: in a random order paths
    are short, log(n) with high probability, so a few doublings do; the loop ends when all have arrived, whatever their length.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("node")).agg(F.min(_order("b", seed)).alias("first"))
    to = F.least(F.col("first"), _order("node", seed))["node"]
    at = scratch.store(first.select("node", to.alias("to")).withColumn("done", F.col("to") == F.col("node")))
    while at.where("NOT done").take(1):
        far = at.select(F.col("node").alias("via"), F.col("to").alias("far"), F.col("done").alias("far_done"))
        # An end points to itself and is done; who points to an end has arrived as well.
        at = scratch.store(at.join(far, F.col("to") == F.col("via")).select("node", F.col("far").alias("to"), (F.col("done") | F.col("far_done")).alias("done")))
    return at.select("node", "to")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable; only nodes that have an edge are returned.

    edges: (a, b) longs, in either order, repeats allowed. By contraction: each round every node is led to a local minimum
    of a random order, edges are renamed to where their ends were led, and those within one node go. At least half of the
    nodes with an edge aren't local minima in the mean, so rounds are logarithmic in the largest component whatever its
    shape and its ids, and there is no limit on them. An order serves two rounds, as a star then takes no more. Each
    round's pointers are kept and put together at the end, so labels aren't rewritten every round. State is cut in the shared
    checkpoint folder. An empty edge list gives no rows.
    """
    with Scratch(edges.sparkSession) as scratch:
        left = scratch.store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        steps: list[DataFrame] = []
        while left.take(1):
            to = _pointers(left, len(steps) // 2, scratch)
            steps.append(to)
            x, y = to.select(F.col("node").alias("xa"), F.col("to").alias("x")), to.select(F.col("node").alias("ya"), F.col("to").alias("y"))
            moved = left.join(x, F.col("a") == F.col("xa")).select("x", "b").join(y, F.col("b") == F.col("ya")).where("x <> y")
            left = scratch.store(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not steps:
            return scratch.keep(left.select(F.col("a").alias("node"), F.col("b").alias("root")))
        led = steps[-1]
        for earlier in reversed(steps[:-1]):
            end = led.select(F.col("node").alias("via"), F.col("to").alias("end"))
            led = scratch.store(earlier.join(end, F.col("to") == F.col("via"), "left").select("node", F.coalesce("end", "to").alias("to")))
        least = led.groupBy("to").agg(F.min("node").alias("root")).select(F.col("to").alias("end"), "root")
        return scratch.keep(led.join(least, F.col("to") == F.col("end")).select("node", "root"))
