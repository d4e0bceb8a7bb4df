"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame, label: str) -> DataFrame:
    """node, m: the smallest neighbour. Written, so that a join on a hub's edges can be split."""
    return materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), label)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node that an edge (columns a and b of one type) names.

    Loops, repeated and reversed edges are fine; edges with a null end are left out; no edges give no rows. Minima are
    aggregated before the shuffle and joined back on written tables, so a hub's edges spread over tasks. Each round is
    written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both, "least").withColumn("m", F.least("node", "m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large")
        least = _least(large, "least")
        small = large.join(least, F.col("a") == F.col("node")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), "small")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def least_ids(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component (the smallest id that links reach, null if all are null), first (whether the node is the one of its
    component that has it; of several, the smallest) for every node that a link names.

    nodes: node (never null, unique), rep (its smallest id, or null). links: a, b (nodes). The components are those of the
    nodes, so a node without an id still connects its neighbours, and nodes that share an id aren't linked by that.
    """
    found = connected_components(links.select("a", "b")).withColumnRenamed("component", "root")
    found = materialize(found.join(nodes.select("node", "rep"), "node"), "roots")
    least = found.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("least"))
    least = materialize(least.select("root", F.col("least.rep").alias("component"), F.col("least.node").alias("lead")), "ids")
    return found.join(least, "root").select("node", "component", (F.col("node") == F.col("lead")).alias("first"))
