"""Connected components of an edge table.

Alternating large-star and small-star rounds: every round is two aggregations and two joins keyed by node,
no node ever gathers its neighbours in one task, and the number of rounds grows with the logarithm of the
longest path.  Each round is cut off from its lineage with a written table in the shared checkpoint folder,
so a lost executor costs a task, not the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.shared import deleted, scratch, shuffles_deleted, stored_at


def _folder(spark: SparkSession) -> str:
    return scratch(spark, "components")


def _star(links: DataFrame, strictly_larger: bool) -> DataFrame:
    """Point every neighbour of a node to the node's least neighbour (the node itself included)."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = links.join(least, "u")
    if strictly_larger:
        return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )


def connected_components(
    edges: DataFrame,
    src: str = "src",
    dst: str = "dst",
    nodes: DataFrame | None = None,
    max_rounds: int = 60,
) -> DataFrame:
    """``(node, component)`` where component is the least node that can be reached.

    ``nodes`` (one column) adds isolated nodes.  Edges with a null end only contribute their other end; self
    loops and repeated edges are harmless; no edges give only the isolated nodes.
    """
    spark, folder = edges.sparkSession, _folder(edges.sparkSession)
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    every = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.toDF("node"))
    now = (
        pairs.where("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    for k in range(max_rounds):
        now = stored_at(now, f"{folder}/{k}")
        if k:
            deleted(spark, f"{folder}/{k - 1}")
        # a star forest is a fixed point: compare sizes and a checksum of the links
        with shuffles_deleted(spark):
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).where("u != v").distinct()
        now = _star(large, False).where("u != v").distinct()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    every = every.where("node is not null").distinct()
    return every.join(now.toDF("node", "component"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
