"""Does the payment graph know owners?  Scores of pairs inside and across clusters, by depth, entity and overlap.

Pairs of a cluster are never listed for their own sake: what is counted is how many of them share how many
neighbours.  Those that share some are met at the neighbour; the others are the rest of the cluster's pairs, a
number.  Negative pairs, where the original draws them, are neighbours in a hashed order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph, hashing
from sparkloom.operators.metrics import auc, auc_of_counts
from sparkloom.operators.shared import deleted, scratch, stored, stored_at


def shared_counts(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``n``, their number of common neighbours; only the asked pairs' edges are joined."""
    got = (
        pairs.select("a", "b").distinct()
        .join(edges.select(F.col("src").alias("a"), F.col("dst").alias("via")), "a")
        .join(edges.select(F.col("src").alias("b"), F.col("dst").alias("via")), ["b", "via"])
        .groupBy("a", "b").agg(F.count("*").alias("n"))
    )
    return pairs.join(got, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def inside_counts(clusters: DataFrame, cospent: DataFrame, edges: DataFrame) -> DataFrame:
    """``(s, p)``: how many pairs of one cluster (cluster, address) that were not spent together (a, b, a < b) have s
    common neighbours."""
    mine = edges.select(F.col("src").alias("address"), F.col("dst").alias("via")).join(clusters, "address")
    met = mine.select("cluster", "via", F.col("address").alias("a")).join(mine.select("cluster", "via", F.col("address").alias("b")), ["cluster", "via"]).where("a < b")
    some = met.groupBy("a", "b").agg(F.count("*").alias("s")).join(cospent, ["a", "b"], "left_anti").groupBy("s").agg(F.count("*").alias("p"))
    some = stored(some, "inside-counts")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    every = sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint").alias("pairs"))
    together = cospent.join(clusters.select(F.col("address").alias("a"), F.col("cluster").alias("ca")), "a").join(clusters.select(F.col("address").alias("b"), F.col("cluster").alias("cb")), "b")
    apart = together.where("ca = cb").agg(F.count("*").alias("spent"))
    listed = some.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("listed"))
    rest = every.crossJoin(apart).crossJoin(listed).select(F.lit(0).cast("bigint").alias("s"), (F.col("pairs") - F.col("spent") - F.col("listed")).alias("p"))  # three single rows
    return some.unionByName(rest.where("p > 0"))


def across_pairs(clusters: DataFrame, salt: int = 3) -> DataFrame:
    """``(a, b)``, a < b: neighbours in hashed order that are in different clusters."""
    x = hashing.neighbours(clusters.select(F.col("address").alias("key"), "cluster"), "key", salt)
    other = clusters.select(F.col("address").alias("other"), F.col("cluster").alias("oc"))
    return x.join(other, "other").where("oc != cluster").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))


def structure_auc(clusters: DataFrame, cospent: DataFrame, edges: DataFrame, salt: int = 3) -> DataFrame:
    """One row (auc, n_pos, n_neg): do two addresses of a cluster share more neighbours than two of different ones?

    Edges and negative pairs are read several times, so they are written first and deleted when the counts are."""
    spark, folder = edges.sparkSession, scratch(edges.sparkSession, "structure")
    edges, across = stored_at(edges, f"{folder}/edges"), stored_at(across_pairs(clusters, salt), f"{folder}/across")
    inside = inside_counts(clusters, cospent, edges).select("s", "p", F.lit(0).cast("bigint").alias("q"))
    outside = shared_counts(across, edges).groupBy(F.col("n").alias("s")).agg(F.count("*").alias("q"))
    counts = inside.unionByName(outside.select("s", F.lit(0).cast("bigint").alias("p"), "q"))
    got = auc_of_counts(counts.groupBy("s").agg(F.sum("p").alias("p"), F.sum("q").alias("q")))  # writes the counts
    deleted(spark, folder)
    return got


def entity_partition(labelled: DataFrame) -> DataFrame:
    """``(cluster, address)`` by the entity that a detector names (address, entity); an address of several entities
    ties them, as the least of their names."""
    from sparkloom.operators.components import connected_components

    named = labelled.where("address is not null and entity is not null").select("address", F.concat(F.lit("entity:"), "entity").alias("entity")).distinct()
    got = connected_components(named, "address", "entity")
    least = got.where("node like 'entity:%'").groupBy("component").agg(F.min("node").alias("entity"))
    return got.where("node not like 'entity:%'").join(least, "component").select(F.expr("substring(entity, 8)").alias("cluster"), F.col("node").alias("address"))


def entity_auc(partition: DataFrame, cospent: DataFrame, edges: DataFrame, salt: int = 5) -> DataFrame:
    """One row (entities, auc, n_pos, n_neg): pairs of one entity that were not spent together against pairs of an
    entity's address and one of none."""
    everyone = edges.select(F.col("src").alias("address")).distinct()
    mine = partition.join(everyone, "address", "left_semi")
    sizes = mine.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 2")
    held = stored(mine.join(sizes.select("cluster"), "cluster", "left_semi").select("cluster", "address"), "entity-members")
    marked = everyone.join(mine.select("address", F.lit(True).alias("known")), "address", "left").select(F.col("address").alias("key"), F.coalesce("known", F.lit(False)).alias("known"))
    x = hashing.neighbours(marked, "key", salt).join(marked.select(F.col("key").alias("other"), F.col("known").alias("ok")), "other").where("known != ok")
    negative = shared_counts(x.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")), edges).groupBy(F.col("n").alias("s")).agg(F.count("*").alias("q"))
    counts = inside_counts(held, cospent, edges).select("s", "p", F.lit(0).cast("bigint").alias("q")).unionByName(negative.select("s", F.lit(0).cast("bigint").alias("p"), "q"))
    got = auc_of_counts(counts.groupBy("s").agg(F.sum("p").alias("p"), F.sum("q").alias("q")))
    return held.agg(F.count_distinct("cluster").alias("entities")).crossJoin(got)  # single rows


#: Edges up to which the graph is held by every Python worker, as two arrays of numbers.
MOST_EDGES = 10_000_000
#: Pairs that a task walks from, about.
_TASK_PAIRS = 2_000


def _walks(graph_of, depth: int, hub_degree: int, most: int):
    """Over (positive, a, b), the nodes' numbers or null: (positive, met), how many nodes both reach within 1, 2, .. steps,
    by the rules of ``graph.k_hop``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, dst = graph_of.value
        n = len(first) - 1
        degree = np.diff(first)
        seen, place = [np.full(n, -1, np.int64) for _ in range(2)], np.zeros(n, np.int64)
        hop_of_a, token = np.zeros(n, np.int8), -1

        def walk(start: int, seen: np.ndarray, token: int) -> tuple[np.ndarray, np.ndarray]:
            seen[start] = token
            at, nodes, reached = np.array([start]), [], 0
            for hop in range(1, depth + 1):
                if hop > 1:
                    if reached > most:
                        break
                    at = at[degree[at] <= hub_degree]
                d = degree[at]
                ways = dst[np.repeat(first[at] - np.cumsum(d) + d, d) + np.arange(d.sum())]
                ways = ways[seen[ways] != token]
                place[ways] = np.arange(len(ways))
                at = ways[place[ways] == np.arange(len(ways))]  # each once
                seen[at] = token
                reached += len(at)
                nodes.append(at)
            return np.concatenate(nodes), np.repeat(np.arange(1, len(nodes) + 1), [len(x) for x in nodes])

        for batch in batches:
            positive, a, b = (batch.column(i).to_pylist() for i in range(3))
            met = []
            for x, y in zip(a, b, strict=True):
                if x is None or y is None:
                    met.append([0] * depth)
                    continue
                token += 1
                nodes, hops = walk(x, seen[0], token)
                hop_of_a[nodes] = hops
                others, far = walk(y, seen[1], token)
                both = (seen[0][others] == token) & (others != x)
                k = np.maximum(hop_of_a[others[both]], far[both])
                met.append(np.cumsum(np.bincount(k, minlength=depth + 1)[1:]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(positive, pa.bool_()), pa.array(met, pa.list_(pa.int64()))], names=["positive", "met"])

    return run


def _met_in_memory(pairs: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    spark = edges.sparkSession
    numbers = stored(hashing.ranked(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "node").select("node", (F.col("rank") - 1).cast("int").alias("i")), "sweep-numbers")
    ends = edges.join(numbers.toDF("src", "s"), "src").join(numbers.toDF("dst", "d"), "dst").select("s", "d").toArrow()
    s, d = (ends.column(i).to_numpy() for i in range(2))
    first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=numbers.count()))])
    held = spark.sparkContext.broadcast((first, d[np.argsort(s, kind="stable")]))
    named = pairs.join(numbers.toDF("a", "ia"), "a", "left").join(numbers.toDF("b", "ib"), "b", "left").select("positive", "ia", "ib")
    dealt = named.repartition(1 + pairs.count() // _TASK_PAIRS)
    return dealt.mapInArrow(_walks(held, depth, graph.HUB_DEGREE, graph.MOST_REACHED), "positive boolean, met array<long>")


def _met_by_joins(pairs: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    starts = pairs.select(F.explode(F.array("a", "b")).alias("start")).distinct()
    reach = stored(graph.k_hop(edges, starts, depth), "sweep-reach")
    near = pairs.join(reach.toDF("a", "via", "ha"), "a").join(reach.toDF("b", "via", "hb"), ["b", "via"]).withColumn("k", F.greatest("ha", "hb"))
    met = near.groupBy("a", "b", "positive").agg(F.array(*(F.count_if(F.col("k") <= k) for k in range(1, depth + 1))).alias("met"))
    none = F.array_repeat(F.lit(0).cast("long"), depth)
    return pairs.join(met, ["a", "b", "positive"], "left").select("positive", F.coalesce("met", none).alias("met"))


def depth_sweep(
    clusters: DataFrame, cospent: DataFrame, edges: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 4), salt: int = 7, most_edges: int | None = None
) -> DataFrame:
    """``(k, auc, n_pos, n_neg, share)``: as ``structure_auc``, but of neighbourhoods within k steps, and the share of
    positive pairs that share a neighbour.  Positive pairs are neighbours in hashed order within a cluster.

    Up to ``MOST_EDGES`` edges, workers hold the graph and walk from both ends of each pair, so that neighbourhoods,
    thousands of nodes a start, are never written; beyond it they are joined."""
    spark = edges.sparkSession
    if not ks:
        return spark.createDataFrame([], "k int")
    same = hashing.neighbours(clusters.select(F.col("address").alias("key"), "cluster"), "key", salt, ["cluster"])
    pos = same.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).join(cospent, ["a", "b"], "left_anti")
    pairs = stored(pos.withColumn("positive", F.lit(True)).unionByName(across_pairs(clusters, salt).withColumn("positive", F.lit(False))), "sweep-pairs")
    edges = stored(edges, "sweep-edges")
    way = _met_in_memory if edges.count() <= (MOST_EDGES if most_edges is None else most_edges) else _met_by_joins
    found = stored(way(pairs, edges, max(ks)), "sweep-counts")
    out = None
    for k in ks:
        row = auc(found.select(F.get("met", F.lit(k - 1)).alias("score"), "positive")).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    share = found.agg(F.coalesce(F.try_divide(F.count_if(F.col("positive") & (F.get("met", F.lit(0)) > 0)), F.count_if("positive")), F.lit(0.0)).alias("share"))
    return out.crossJoin(F.broadcast(share)).select("k", "auc", "n_pos", "n_neg", "share")  # one row


def overlap_calibration(clusters: DataFrame, edges: DataFrame, cap: float = graph.SHARE_CAP, salt: int = 11) -> DataFrame:
    """One row (clusters, same_mean, cross_mean, auc): overlap bits of two halves of a cluster against those of two
    clusters that are neighbours in hashed order; only what touches anything counts."""
    touching = clusters.join(edges.select(F.col("src").alias("address")).distinct(), "address", "left_semi")
    w = Window.partitionBy("cluster")
    h = hashing.hashed(F.col("address"), salt)
    sized = touching.withColumn("n", F.count("*").over(w)).where("n >= 2").withColumn("k", F.row_number().over(w.orderBy(h, "address")))
    halves = stored(sized.withColumn("half", F.when(F.col("k") <= F.floor(F.col("n") / 2), 0).otherwise(1)).select("cluster", "address", "half"), "halves")
    neigh = edges.select(F.col("src").alias("node"), F.col("dst").alias("cp"))
    cbits = stored(graph.counterparty_bits(neigh), "halves-bits")
    touched = halves.join(neigh.withColumnRenamed("node", "address"), "address")
    of_half = touched.select(F.concat_ws("/", F.col("half").cast("string"), "cluster").alias("node"), "cp").distinct()
    of_whole = touched.select(F.col("cluster").alias("node"), "cp").distinct()
    names = halves.select("cluster").distinct()
    same = names.select(F.concat(F.lit("0/"), "cluster").alias("a"), F.concat(F.lit("1/"), "cluster").alias("b"))
    cross = hashing.neighbours(names, "cluster", salt).select(F.least("cluster", "other").alias("a"), F.greatest("cluster", "other").alias("b"))
    bits = F.round(F.least(F.coalesce("shared_bits", F.lit(0.0)), F.lit(cap)), 9)
    scored = graph.overlap(same, of_half, cbits).select(bits.alias("score"), F.lit(True).alias("positive")).unionByName(
        graph.overlap(cross, of_whole, cbits).select(bits.alias("score"), F.lit(False).alias("positive"))
    )
    scored = stored(scored, "halves-scored")
    means = scored.agg(F.avg(F.when(F.col("positive"), F.col("score"))).alias("same_mean"), F.avg(F.when(~F.col("positive"), F.col("score"))).alias("cross_mean"))
    return names.agg(F.count("*").alias("clusters")).crossJoin(means).crossJoin(auc(scored).select("auc"))  # single rows
