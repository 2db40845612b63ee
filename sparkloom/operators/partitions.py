"""Partitions that come from elsewhere: whole-corpus lookups, label assignments, and how clusters grow with the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.components import connected_components
from sparkloom.operators.shared import stored

FRACTIONS = (0.1, 0.25, 0.5, 0.75, 1.0)


def _stars(txs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node) of all funders, and star edges between those of one transaction."""
    funders = F.filter(F.transform("vin", lambda v: v["txid"]), lambda t: t.isNotNull())
    x = txs.select(funders.alias("f")).where(F.size("f") > 0)
    return x.select(F.explode("f").alias("node")).distinct(), x.select(F.array_min("f").alias("src"), F.explode("f").alias("dst"))


def cospend_lookup(txs: DataFrame) -> DataFrame:
    """``(node, cluster)`` of every funder in the corpus: funders of one transaction are together."""
    nodes, edges = _stars(txs)
    return connected_components(edges, nodes=nodes).toDF("node", "cluster")


def from_lookup(nodes: DataFrame, lookup: DataFrame) -> DataFrame:
    """``(node, position, cluster)`` of a list of nodes (node, position) by a lookup (node, cluster); a place of the
    list whose node is unknown is a cluster of its own, named after the place, even if the node repeats."""
    alone = F.concat(F.lit("_s"), F.col("position").cast("string"))
    return nodes.join(lookup, "node", "left").select("node", "position", F.coalesce(F.col("cluster").cast("string"), alone).alias("cluster"))


def from_assignment(assigned: DataFrame) -> DataFrame:
    """``(label, n, first)``: the clusters that an assignment (node, label) makes, with size and least node; members
    stay rows of the assignment, since a cluster may be of any size."""
    return assigned.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("first"))


def ordered(txs: DataFrame) -> DataFrame:
    """``txs`` with ``position``, from 1 on by (height, clock): heights are counted, then each is ranked by itself."""
    heights = txs.groupBy("height").agg(F.count("*").alias("__n"))  # a row per block
    before = F.coalesce(F.sum("__n").over(Window.orderBy("height").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("height").orderBy("clock"))
    return txs.join(F.broadcast(heights.select("height", before.alias("__before"))), "height").withColumn("position", F.col("__before") + inside).drop("__before")


def scale_curve(txs: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """``(fraction, txs, funders, entities, per_funder)`` over growing prefixes in time.  All prefixes go through the
    component rounds together, their nodes told apart by the prefix."""
    spark = txs.sparkSession
    placed = stored(ordered(txs).select("position", "vin"), "scale-order")
    n = placed.count()
    cuts = spark.createDataFrame([(float(f), max(1, int(n * f))) for f in fractions], "fraction double, upto bigint")
    prefix = placed.crossJoin(F.broadcast(cuts)).where(F.col("position") <= F.col("upto"))  # a row per fraction
    funders = F.filter(F.transform("vin", lambda v: F.concat_ws("/", F.col("fraction").cast("string"), v["txid"])), lambda t: t.isNotNull())
    x = prefix.select(funders.alias("f")).where(F.size("f") > 0)
    found = connected_components(x.select(F.array_min("f").alias("src"), F.explode("f").alias("dst")))
    per = found.groupBy(F.substring_index("node", "/", 1).cast("double").alias("fraction")).agg(F.count("*").alias("funders"), F.count_if(F.col("node") == F.col("component")).alias("entities"))
    return cuts.join(per, "fraction", "left").select(
        "fraction", F.col("upto").alias("txs"), F.coalesce("funders", F.lit(0)).alias("funders"), F.coalesce("entities", F.lit(0)).alias("entities"),
        F.coalesce(F.try_divide("entities", "funders"), F.lit(0.0)).alias("per_funder"),
    )


def window_against_corpus(txs: DataFrame, share: float = 0.1) -> DataFrame:
    """One row (funders, window_entities, corpus_entities): clusters of a first window's funders, by the window's own
    co-spends and by the whole corpus's."""
    placed = stored(ordered(txs), "window-order")
    upto = max(1, int(placed.count() * share))
    own = stored(cospend_lookup(placed.where(F.col("position") <= upto)), "window-own")
    whole = cospend_lookup(placed).withColumnRenamed("cluster", "corpus")
    return own.join(whole, "node", "left").agg(
        F.count("*").alias("funders"), F.count_distinct("cluster").alias("window_entities"), F.count_distinct(F.coalesce("corpus", "node")).alias("corpus_entities")
    )


def ancestor_sample(txs: DataFrame, start: DataFrame, depth: int = 6, most: int = 60) -> DataFrame:
    """``(txid, level)`` of transactions that funded the starts (column txid), back to ``depth``; level by level, the
    least ids first, until there are ``most``, which is what the sample asks for."""
    edges = stored(txs.select("txid", F.explode("vin").alias("v")).select("txid", F.col("v.txid").alias("parent")).distinct(), "ancestor-edges")
    known = txs.select(F.col("txid").alias("parent"))
    seen = start.select("txid").distinct().withColumn("level", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        fresh = frontier.join(edges, "txid").select(F.col("parent")).distinct().join(known, "parent", "left_semi").toDF("txid").join(seen, "txid", "left_anti")
        frontier = stored(fresh.withColumn("level", F.lit(level)), "ancestor-level")
        seen = seen.unionByName(frontier)
    return seen.orderBy("level", "txid").limit(most)


def bounded_groups(groups: DataFrame, cap: int, base: DataFrame | None = None) -> DataFrame:
    """``(group, node)`` of whole groups (group, node), the smallest first, as long as their nodes besides ``base``
    (column node) add up to at most ``cap``; a group that doesn't fit is passed over.

    At most ``cap`` groups bring a node of their own, so the choice among those is made on the driver, some at a time."""
    own = groups if base is None else groups.join(base.select("node"), "node", "left_anti")
    fresh = own.groupBy("group").agg(F.count("*").alias("fresh"))
    sizes = stored(groups.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("first")).join(fresh, "group", "left").na.fill(0, ["fresh"]), "group-sizes")
    left, at, kept = cap, (0, ""), []
    while left > 0:
        after = (F.col("n") > at[0]) | ((F.col("n") == at[0]) & (F.col("first") > at[1]))
        some = sizes.where((F.col("fresh") > 0) & (F.col("fresh") <= left) & after).orderBy("n", "first").limit(cap).collect()
        if not some:
            break
        for r in some:
            at = (r["n"], r["first"])
            if r["fresh"] <= left:
                kept.append(r["group"])
                left -= r["fresh"]
    chosen = groups.sparkSession.createDataFrame([(g,) for g in kept], groups.select("group").schema)
    free = sizes.where("fresh = 0").select("group")
    return groups.join(F.broadcast(chosen).unionByName(free), "group", "left_semi").select("group", "node")
