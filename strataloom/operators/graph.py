"""Importance, reach and neighbourhoods over an edge list (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import durable


def importance(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(node, rank): simplified page rank, scaled so that the highest is 1.

    Repeated edges count once, edges with an end outside ``nodes`` not at all; the mass of nodes without outgoing
    edges is dropped. Lineage is cut every few iterations. Incoming mass is combined map-side, so a node that all
    others point at is one aggregation row per task.
    """
    nodes = durable(nodes.select("node").where("node is not null").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    links = edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    links = durable(links.join(links.groupBy("src").agg(F.count("*").alias("deg")), "src"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(iterations):
        mass = links.join(ranks.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("m"))
        ranks = nodes.join(mass.withColumnRenamed("dst", "node"), "node", "left").select("node", ((1 - damping) / n + damping * F.coalesce("m", F.lit(0.0))).alias("rank"))
        if i % cut_every == cut_every - 1:
            ranks = durable(ranks)
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).select("node", (F.col("rank") / F.greatest("top", F.lit(1e-9))).alias("rank"))  # one row


def reach(edges: DataFrame, starts: DataFrame, depth: int, up: bool = False) -> DataFrame:
    """(start, node, steps): what each start reaches within ``depth`` steps, by the shortest way, itself at 0."""
    links = (edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if up else edges.select("src", "dst")).distinct()
    seen = starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("steps"))
    edge = seen
    for d in range(1, depth + 1):
        step = edge.select("start", F.col("node").alias("src")).join(links, "src").select("start", F.col("dst").alias("node")).distinct()
        edge = step.join(seen, ["start", "node"], "left_anti").withColumn("steps", F.lit(d))
        seen = durable(seen.unionByName(edge))
        edge = seen.where(F.col("steps") == d)
    return seen


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, inbound, outbound) with zeros."""
    inbound = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inbound"))
    outbound = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outbound"))
    return nodes.select("node").distinct().join(inbound, "node", "left").join(outbound, "node", "left").na.fill(0, ["inbound", "outbound"])


def layers(edges: DataFrame, focus: str, depth: int) -> DataFrame:
    """(node, layer): steps from a focus along the links (positive) or against them (negative), the nearer way first."""
    start = edges.sparkSession.createDataFrame([(focus,)], "start string")
    down = reach(edges, start, depth).select("node", F.col("steps").alias("d"))
    up = reach(edges, start, depth, up=True).select("node", F.col("steps").alias("u"))
    nearer = F.col("d").isNull() | (F.col("u") < F.col("d"))
    return down.join(up, "node", "full_outer").select("node", F.when(nearer, -F.col("u")).otherwise(F.col("d")).alias("layer"))


def collections(edges: DataFrame, src_group, dst_group) -> DataFrame:
    """(g, internal, users, used) of each group of nodes: weight inside it, different nodes outside that use it or are used."""
    e = edges.withColumn("a", src_group).withColumn("b", dst_group)
    each = e.withColumn("g", F.explode(F.array_distinct(F.array("a", "b"))))
    apart = F.col("a") != F.col("b")
    return each.groupBy("g").agg(
        F.coalesce(F.sum(F.when(~apart, F.col("weight"))), F.lit(0)).alias("internal"),
        F.count_distinct(F.when(apart & (F.col("b") == F.col("g")), F.col("src"))).alias("users"),
        F.count_distinct(F.when(apart & (F.col("a") == F.col("g")), F.col("dst"))).alias("used"),
    )
