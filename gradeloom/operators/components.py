"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.hot_keys import look_up
from gradeloom.operators.ranking import numbered
from gradeloom.plans.durable import is_small, written


def _star(edges: DataFrame, number: int, large: bool) -> DataFrame:
    """Tie the larger (or all smaller) neighbours of every node to the smallest node around it."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("_n")).withColumn("low", F.least("a", "low")))
    tied = look_up(both, least, "a", 2 * number, small=is_small(least))
    if large:
        return tied.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
    own = least.select("a", F.col("low").alias("b"))
    return tied.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(own).filter("a <> b").distinct()


def duplicate_clusters(nodes: DataFrame, edges: DataFrame, node: str = "path") -> DataFrame:
    """``node, root, cluster`` of all nodes that an edge ties to another: components numbered from 1 by their least node.

    Numbers are given by ranges of roots, so that no task holds all clusters.
    """
    roots = written(connected_components(edges).join(nodes.select(F.col(node).alias("node")).distinct().hint("merge"), "node", "left_semi"))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    placed = written(numbered(sizes.withColumn("_all", F.lit(0)), "_all", [F.col("root")], "cluster").drop("_all"))
    return look_up(roots, placed, "root", roots.count()).select(F.col("node").alias(node), "root", F.col("cluster").cast("long").alias("cluster"))


def every_cluster(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``path, root, cluster`` of every row of ``path, rep``: the component that its representative is in, alone or with others.

    ``roots`` has ``node, root`` of the representatives that a link ties to another. Components are numbered from 1 by their root, by ranges of roots.
    """
    members = written(members)
    reps = written(members.groupBy("rep").agg(F.count(F.lit(1)).alias("_n")))
    of = roots.select(F.col("node").alias("rep"), "root")
    reps = written(reps.join(of.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    sizes = reps.groupBy("root").agg(F.count(F.lit(1)).alias("_m"))
    placed = written(numbered(sizes.withColumn("_all", F.lit(0)), "_all", [F.col("root")], "cluster").drop("_all"))
    known = written(look_up(reps, placed, "root", reps.count(), count="_m"))
    return look_up(members, known, "rep", members.count()).select("path", "root", F.col("cluster").cast("long").alias("cluster"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node that an edge names.

    Direction, repetition and loops do not matter; edges with a null end are left out. Every round is
    two joins and two aggregations on the edges, written to the shared folder; the number of rounds grows with the logarithm of the number of nodes.
    """
    ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = written(ends.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    loops = now.filter("a = b").select("a").distinct()
    now = now.filter("a <> b")
    summary, number = None, now.count()
    while True:
        # a node with a large part of all edges is met where its edges lie, in both steps
        now = written(_star(written(_star(now, number, large=True)), 2 * number, large=False))
        latest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if latest == summary:
            break
        summary, number = latest, latest[0]
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    alone = loops.join(roots.select(F.col("node").alias("a")).hint("merge"), "a", "left_anti")
    return roots.unionByName(alone.select(F.col("a").alias("node"), F.col("a").alias("root")))
