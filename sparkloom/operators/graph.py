"""The payment graph: who pays whom, who spends together, and how much neighbourhoods overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.change import input_addresses

DISJOINT_BITS, PAIR_DISJOINT_BITS, SHARE_CAP = -8.1, -1.65, 12.0
HUB_DEGREE, MOST_REACHED = 100, 6000


def output_addresses():
    return F.array_distinct(F.filter(F.transform("vout", lambda o: o["scriptpubkey_address"]), lambda a: a.isNotNull()))


def pay_edges(txs: DataFrame) -> DataFrame:
    """``(src, dst)``: input to output addresses and back, distinct."""
    pairs = txs.select(F.explode(input_addresses()).alias("src"), output_addresses().alias("o")).select("src", F.explode("o").alias("dst"))
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def full_edges(txs: DataFrame) -> DataFrame:
    """``(src, dst)``: any two different addresses of one transaction, both ways."""
    every = F.array_distinct(F.concat(input_addresses(), output_addresses()))
    x = txs.select(every.alias("a")).select(F.explode("a").alias("src"), "a").select("src", F.explode("a").alias("dst"))
    return x.where("src != dst").distinct()


def cospent_addresses(txs: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: addresses spent together."""
    x = txs.select(input_addresses().alias("i")).where(F.size("i") > 1)
    return x.select(F.explode("i").alias("a"), "i").select("a", F.explode("i").alias("b")).where("a < b").distinct()


def common_neighbours(edges: DataFrame) -> DataFrame:
    """``(a, b, n)``, a < b: nodes with common neighbours."""
    left, right = edges.select(F.col("dst").alias("via"), F.col("src").alias("a")), edges.select(F.col("dst").alias("via"), F.col("src").alias("b"))
    return left.join(right, "via").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def k_hop(edges: DataFrame, starts: DataFrame, k: int, hub_degree: int = HUB_DEGREE, most: int = MOST_REACHED) -> DataFrame:
    """``(start, node, hop)`` within k hops; hubs other than the start are not passed through, and a start that
    has reached more than ``most`` nodes goes no further."""
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    open_nodes = degree.where(F.col("d") <= hub_degree).select(F.col("src").alias("node"))
    reached = starts.toDF("start").select("start", F.col("start").alias("node"), F.lit(0).alias("hop"))
    frontier = reached
    for hop in range(1, k + 1):
        if hop > 1:
            sizes = reached.groupBy("start").agg((F.count("*") - 1).alias("n")).where(F.col("n") <= most).select("start")
            frontier = frontier.join(open_nodes, "node", "left_semi").join(sizes, "start", "left_semi")
        nxt = (
            frontier.join(edges.withColumnRenamed("src", "node"), "node")
            .select("start", F.col("dst").alias("node"))
            .distinct()
            .join(reached.select("start", "node"), ["start", "node"], "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        reached, frontier = reached.unionByName(nxt), nxt
    return reached.where("hop > 0")


def funder_neighbours(txs: DataFrame) -> DataFrame:
    """``(node, cp)``: the addresses that a transaction, as a node, touches."""
    every = F.array_distinct(F.concat(input_addresses(), output_addresses()))
    return txs.select(F.col("txid").alias("node"), F.explode(every).alias("cp"))


def counterparty_bits(neigh: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """``(cp, bits)``: how rare it is to touch a counterparty; known hubs have none."""
    nodes = neigh.agg(F.count_distinct("node").alias("nodes"))
    touched = neigh.distinct().groupBy("cp").agg(F.count("*").alias("touch"))
    bits = touched.crossJoin(F.broadcast(nodes)).select("cp", (-F.log2(F.col("touch") / F.col("nodes"))).alias("bits"))  # one row
    if hubs is None:
        return bits
    known = hubs.select(F.col("address").alias("cp"), F.lit(True).alias("hub")).distinct()
    return bits.join(known, "cp", "left").select("cp", F.when(F.col("hub"), 0.0).otherwise(F.col("bits")).alias("bits"))


def overlap(pairs: DataFrame, neigh: DataFrame, cbits: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with shared (count) and shared_bits; null where nothing is shared.

    Only the side of a pair that touches less is listed and looked up on the other, so a large cluster in many pairs
    is not listed for each of them."""
    sizes = neigh.groupBy("node").agg(F.count("*").alias("n"))
    sized = pairs.select(a, b).distinct().join(sizes.toDF(a, "__na"), a).join(sizes.toDF(b, "__nb"), b)
    less = F.col("__na") <= F.col("__nb")
    x = (
        sized.select(a, b, F.when(less, F.col(a)).otherwise(F.col(b)).alias("__less"), F.when(less, F.col(b)).otherwise(F.col(a)).alias("__more"))
        .join(neigh.select(F.col("node").alias("__less"), "cp"), "__less")
        .join(neigh.select(F.col("node").alias("__more"), "cp"), ["__more", "cp"])
        .join(cbits, "cp")
        .groupBy(a, b)
        .agg(F.count("*").alias("shared"), F.sum("bits").alias("shared_bits"))
    )
    return pairs.join(x, [a, b], "left")


def plain_overlap_bits(shared: Column, cap: float = SHARE_CAP) -> Column:
    """Bits of a number of shared counterparties where their rarity isn't known: one and a half each, for four at most."""
    return F.least(1.5 * F.least(F.coalesce(shared, F.lit(0)), F.lit(4)), F.lit(cap))


def topology_weight(pairs: DataFrame, neigh: DataFrame, cbits: DataFrame, disjoint: float = PAIR_DISJOINT_BITS, cap: float = SHARE_CAP, tau: float | None = None) -> DataFrame:
    """``pairs`` (a, b) with ``topology``: 0 if either side touches nothing, ``disjoint`` if nothing is shared
    (or, given ``tau``, less than that), else the shared bits up to the cap."""
    some = neigh.select("node").distinct()
    x = overlap(pairs, neigh, cbits)
    for side in ("a", "b"):
        x = x.join(some.select(F.col("node").alias(side), F.lit(True).alias(f"has_{side}")), side, "left")
    bits = F.least(F.col("shared_bits"), F.lit(cap))
    far = F.col("shared").isNull() if tau is None else F.col("shared").isNull() | (bits < tau)
    weight = F.when(F.col("has_a").isNull() | F.col("has_b").isNull(), 0.0).when(far, disjoint).otherwise(bits)
    return x.withColumn("topology", weight).drop("has_a", "has_b", "shared", "shared_bits")


def cluster_bits(members: DataFrame, edges: DataFrame, topk: int = 5) -> DataFrame:
    """``(cluster, size, n_external, bits, top_bits)`` of clusters of two or more: the rarity of the
    counterparties outside each cluster, in all and of the ``topk`` rarest."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size")).where("size >= 2")
    mine = members.join(sizes, "cluster")
    cps = mine.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("cp")), "node").select("cluster", "cp").distinct()
    outside = cps.join(members.select("cluster", F.col("node").alias("cp")), ["cluster", "cp"], "left_anti")
    touched = edges.groupBy("dst").agg(F.count_distinct("src").alias("touch")).withColumnRenamed("dst", "cp")
    nodes = edges.agg(F.count_distinct("src").alias("nodes"))
    weighed = outside.join(touched, "cp").crossJoin(F.broadcast(nodes)).withColumn("bits", -F.log2(F.col("touch") / F.col("nodes")))  # one row
    ranked = weighed.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("bits"), "cp")))
    got = ranked.groupBy("cluster").agg(
        F.count("*").alias("n_external"), F.sum("bits").alias("bits"), F.sum(F.when(F.col("k") <= topk, F.col("bits")).otherwise(0.0)).alias("top_bits")
    )
    return sizes.join(got, "cluster", "left").select(
        "cluster", "size", F.coalesce("n_external", F.lit(0)).alias("n_external"), F.coalesce("bits", F.lit(0.0)).alias("bits"), F.coalesce("top_bits", F.lit(0.0)).alias("top_bits")
    )
