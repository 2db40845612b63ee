"""Provenance of coins: walks forward and backward, signatures over origins, and what they share."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.change import spends
from sparkloom.operators.components import _folder
from sparkloom.operators.hashing import ranked
from sparkloom.operators.shared import stored

MOST_COINS = 22
MOST_MAPPINGS = 200_000
MIX_LEAST = 20


def is_mix(least: int = MIX_LEAST) -> Column:
    return (F.size("vin") >= least) & (F.size("vout") >= least)


@lru_cache(maxsize=4096)
def link_matrix(ins: tuple[int, ...], outs: tuple[int, ...], most: int = MOST_COINS) -> list[list[float]] | None:
    """Share of the finest balanced mappings in which input i and output o lie in one sub-transaction.

    Sub-transactions balance exactly but for one, which pays the whole fee; a mapping counts if no part of it
    can be split further.  None where coins are missing, too many (the sums of all subsets are held), where there are
    more than ``MOST_MAPPINGS`` mappings, or where the outputs exceed the inputs."""
    n, m = len(ins), len(outs)
    if not n or not m or n + m > most or sum(ins) < sum(outs):
        return None
    balance = np.zeros(1, dtype=np.int64)
    for v in [*ins, *(-o for o in outs)]:
        balance = np.concatenate([balance, balance + v])
    full, in_bits = (1 << (n + m)) - 1, (1 << n) - 1
    fee = int(balance[full])
    mixed = lambda s: bool(s & in_bits and s & ~in_bits)
    even = np.flatnonzero(balance == 0)
    even = even[((even & in_bits) != 0) & ((even & ~in_bits) != 0)]
    even = even[np.argsort(np.bitwise_count(even), kind="stable")]
    atoms = [s for k, s in enumerate(even.tolist()) if not _splits(s, even[:k], in_bits)]
    found: list[list[int]] = []

    def rest_is_atomic(s: int) -> bool:
        return mixed(s) and int(balance[s]) == fee and not any(a & s == a and mixed(s ^ a) for a in atoms)

    def grow(left: int, chosen: list[int], first: int) -> bool:
        """False once there are too many."""
        if not left:
            if fee == 0:
                found.append(chosen)
            return len(found) <= MOST_MAPPINGS
        if fee and rest_is_atomic(left):
            found.append([*chosen, left])
        for k in range(first, len(atoms)):
            if atoms[k] & left == atoms[k] and not grow(left ^ atoms[k], [*chosen, atoms[k]], k + 1):
                return False
        return len(found) <= MOST_MAPPINGS

    if not grow(full, [], 0) or not found:
        return None
    return [
        [sum(any(b >> i & 1 and b >> (n + o) & 1 for b in blocks) for blocks in found) / len(found) for o in range(m)] for i in range(n)
    ]


def _splits(s: int, smaller: np.ndarray, in_bits: int) -> bool:
    """Whether one of the smaller balanced parts leaves a rest of s that has both sides."""
    rest = s ^ smaller[(smaller & ~s) == 0]
    return bool((((rest & in_bits) != 0) & ((rest & ~in_bits) != 0)).any())


def link_matrix_column(ins: Column, outs: Column) -> Column:
    """The matrix of each row, as array<array<double>>; null where it abstains.  Rows have at most a few coins."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            known = x is not None and y is not None and None not in x and None not in y
            rows.append(link_matrix(tuple(x), tuple(y)) if known else None)
        return pa.array(rows, pa.list_(pa.list_(pa.float64())))

    return F.arrow_udf(run, "array<array<double>>")(ins, outs)


def funding_edges(txs: DataFrame, matrix: Column | None = None) -> DataFrame:
    """``(txid, vout, parent_txid, parent_vout, weight)``: the shares in which a coin comes from its
    transaction's inputs.  A coin whose matrix abstains has one row with null parent and weight."""
    ins = F.transform("vin", lambda v: v["prevout"]["value"])
    outs = F.transform("vout", lambda o: o["value"])
    if matrix is None:  # equal lists of amounts are enumerated once
        sums = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, v: s + v)
        asked = txs.select("txid", ins.alias("ins"), outs.alias("outs")).where((F.size("ins") > 0) & (F.size("outs") > 0) & (sums("ins") >= sums("outs")))
        asked = stored(asked, "amounts")
        known = asked.select("ins", "outs").distinct().withColumn("m", link_matrix_column(F.col("ins"), F.col("outs")))
        x = txs.select("txid", "vin", "vout").join(asked.join(known, ["ins", "outs"]).select("txid", "m"), "txid", "left")
    else:
        x = txs.select("txid", "vin", "vout", matrix.alias("m"))
    coins = x.select("txid", "vin", "m", F.posexplode("vout").alias("vout", "o")).drop("o")
    column = F.transform("m", lambda row: F.get(row, F.col("vout")))
    total = F.aggregate(column, F.lit(0.0), lambda s, v: s + v)
    edges = coins.withColumn("column", column).withColumn("total", total)
    known = edges.where("m is not null and total > 0").select(
        "txid", "vout", F.explode(F.arrays_zip("vin", "column")).alias("e"), "total"
    )
    cut = edges.where("m is null").select(
        "txid", "vout", F.lit(None).cast("string").alias("parent_txid"), F.lit(None).cast("int").alias("parent_vout"), F.lit(None).cast("double").alias("weight")
    )
    return known.select(
        "txid", "vout", F.col("e.vin.txid").alias("parent_txid"), F.col("e.vin.vout").cast("int").alias("parent_vout"), (F.col("e.column") / F.col("total")).alias("weight")
    ).unionByName(cut)


def signatures(txs: DataFrame, targets: DataFrame, depth: int = 6, matrix: Column | None = None, max_rounds: int = 60) -> DataFrame:
    """``(target, ancestor, mass, cut)``: where the coin's amount was absorbed, walking back ``depth`` transactions.

    ``targets`` has (txid, vout).  A coin is absorbed where its transaction is unknown, at the depth at which
    it is first met, or where the link matrix abstains (``cut``).  As ancestry has no cycles, pushing mass
    along the edges until none is left moving gives the exact absorption."""
    spark = txs.sparkSession
    folder = _folder(spark)

    def held(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    coin = lambda t, v: F.concat_ws(":", F.col(t), F.col(v).cast("string"))
    edges = held(
        funding_edges(txs, matrix).select(coin("txid", "vout").alias("coin"), F.when(F.col("parent_txid").isNotNull(), coin("parent_txid", "parent_vout")).alias("parent"), "weight"),
        "edges",
    )
    start = targets.select(coin("txid", "vout").alias("target")).distinct().withColumn("coin", F.col("target"))
    seen, frontier = start.withColumn("level", F.lit(0)), start
    for level in range(1, depth + 1):
        nxt = (
            frontier.join(edges.where("parent is not null"), "coin").select("target", F.col("parent").alias("coin")).distinct()
            .join(seen.select("target", "coin"), ["target", "coin"], "left_anti")
        )
        frontier = held(nxt, f"level-{level}")
        seen = seen.unionByName(frontier.withColumn("level", F.lit(level)))
    walked = edges.groupBy("coin").agg(F.bool_or(F.col("parent").isNull()).alias("cut"))
    kinds = held(
        seen.join(walked, "coin", "left").select(
            "target", "coin", ((F.col("level") < depth) & F.col("cut").isNotNull() & ~F.col("cut")).alias("moves"), ((F.col("level") < depth) & F.coalesce("cut", F.lit(False))).alias("cut")
        ),
        "kinds",
    )
    moving = start.withColumn("mass", F.lit(1.0)).join(kinds, ["target", "coin"])
    absorbed = moving.where("not moves").select("target", "coin", "mass")
    moving = held(moving.where("moves").select("target", "coin", "mass"), "moving-0")
    for k in range(1, max_rounds):
        if moving.isEmpty():
            break
        pushed = (
            moving.join(edges, "coin").groupBy("target", F.col("parent").alias("coin")).agg(F.sum(F.col("mass") * F.col("weight")).alias("mass")).join(kinds, ["target", "coin"])
        )
        pushed = held(pushed, f"pushed-{k}")
        absorbed = absorbed.unionByName(pushed.where("not moves").select("target", "coin", "mass"))
        moving = pushed.where("moves").select("target", "coin", "mass")
    else:
        raise RuntimeError(f"mass is still moving after {max_rounds} rounds; the ancestry has a cycle")
    total = absorbed.groupBy("target", "coin").agg(F.sum("mass").alias("mass")).where("mass > 1e-12")
    return total.join(kinds.select("target", "coin", "cut"), ["target", "coin"]).select("target", F.col("coin").alias("ancestor"), "mass", "cut")


def signature_entropy(found: DataFrame) -> DataFrame:
    """``(target, shannon, min_entropy, n_absorbers, truncated)``."""
    return found.groupBy("target").agg(
        F.sum(-F.col("mass") * F.log2("mass")).alias("shannon"),
        (-F.log2(F.max("mass"))).alias("min_entropy"),
        F.count("*").alias("n_absorbers"),
        F.count_if("cut").alias("truncated"),
    )


def rarity(found: DataFrame, ancestor: str = "ancestor") -> DataFrame:
    return found.groupBy(ancestor).agg(F.count("*").alias("support"))


def rarity_weight(support: Column) -> Column:
    return F.when(support > 1, 1 / F.log2(support + 1)).otherwise(F.lit(1.0))


def link_strength(pairs: DataFrame, sigs: DataFrame, rare: DataFrame | None = None) -> DataFrame:
    """``pairs`` (a, b) with ``link``: the mass both carry at common ancestors, weighed by rarity; 0 if none.

    ``sigs`` has (coin, ancestor, mass)."""
    x = pairs.select("a", "b").distinct().join(sigs.toDF("a", "ancestor", "ma"), "a").join(sigs.toDF("b", "ancestor", "mb"), ["b", "ancestor"])
    weight = F.lit(1.0)
    if rare is not None:
        x = x.join(rare, "ancestor", "left")
        weight = rarity_weight(F.coalesce("support", F.lit(1)))
    got = x.groupBy("a", "b").agg(F.sum(F.least("ma", "mb") * weight).alias("link"))
    return pairs.join(got, ["a", "b"], "left").withColumn("link", F.coalesce("link", F.lit(0.0)))


def entity_signature(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """``(label, ancestor, mass)``: the members' signatures, added and brought to 1; ``members`` has (coin, label)."""
    x = members.join(sigs, "coin").groupBy("label", "ancestor").agg(F.sum("mass").alias("mass"))
    total = x.groupBy("label").agg(F.sum("mass").alias("total"))
    return x.join(total, "label").where("total > 0").select("label", "ancestor", (F.col("mass") / F.col("total")).alias("mass"))


def shared_origins(branches: DataFrame, sigs: DataFrame, rare: DataFrame | None = None) -> DataFrame:
    """``(group, ancestor, mass, weight)``: origins in every branch; ``branches`` has (group, coin)."""
    sizes = branches.distinct().groupBy("group").agg(F.count("*").alias("branches"))
    x = branches.distinct().join(sigs, "coin").groupBy("group", "ancestor").agg(F.count("*").alias("n"), F.min("mass").alias("mass"))
    x = x.join(sizes, "group").where("n = branches").select("group", "ancestor", "mass")
    if rare is None:
        return x.withColumn("weight", F.lit(1.0))
    return x.join(rare, "ancestor", "left").select("group", "ancestor", "mass", rarity_weight(F.coalesce("support", F.lit(1))).alias("weight"))


def ranked_origins(branches: DataFrame, sigs: DataFrame, rare: DataFrame | None = None) -> DataFrame:
    """``shared_origins`` with ``position``, from 1 on by falling mass times weight, then by name."""
    order = Window.partitionBy("group").orderBy(F.round(F.col("mass") * F.col("weight"), 9).desc(), "ancestor")
    return shared_origins(branches, sigs, rare).withColumn("position", F.row_number().over(order).cast("bigint"))


def intersect(branches: DataFrame, found: DataFrame) -> DataFrame:
    """``(group, branches, smallest, shared, collapsed, collapsed_bits, blind, scored)`` of co-spend candidates.

    ``found`` has (target, ancestor, mass, cut).  An empty intersection has null bits: it refuses, it isn't an
    infinite narrowing.  ``blind``: some branch has no origin that isn't a cut."""
    sigs = found.select(F.col("target").alias("coin"), "ancestor", "mass")
    sizes = found.groupBy(F.col("target").alias("coin")).agg(F.count("*").alias("size"), F.count_if("cut").alias("cuts"))
    each = branches.distinct().join(sizes, "coin", "left").na.fill(0, ["size", "cuts"])
    sums = each.groupBy("group").agg(F.count("*").alias("branches"), F.min("size").alias("smallest"), F.bool_or(F.col("cuts") >= F.col("size")).alias("blind"))
    shared = shared_origins(branches, sigs).groupBy("group").agg(F.count("*").alias("shared"))
    x = sums.join(shared, "group", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    bits = F.when((F.col("smallest") > 0) & (F.col("shared") > 0), F.log2(F.col("smallest") / F.col("shared")))
    return x.select("group", "branches", "smallest", "shared", F.greatest(F.lit(0), F.col("smallest") - F.col("shared")).alias("collapsed"), bits.alias("collapsed_bits"), "blind", F.lit(False).alias("scored"))


def walk_frontier(txs: DataFrame, seeds: DataFrame, max_depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """Follow seeds (txid, vout) forward through ordinary spends.

    Returns the frontier (seed, txid, vout, depth, reason: unspent, coinjoin or depth) and the candidates
    (txid, seeds, n_in, n_out, outpoints): transactions that spend coins of two seeds or more, and those coins."""
    spark = txs.sparkSession
    folder = _folder(spark)

    def held(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    of = txs.select(F.col("txid").alias("spender"), F.size("vin").alias("n_in"), F.size("vout").alias("n_out"), is_mix().alias("mix"))
    edges = held(spends(txs).join(of, "spender"), "spends")
    now = seeds.select(F.concat_ws(":", "txid", "vout").alias("seed"), "txid", F.col("vout").cast("int").alias("vout")).distinct()
    seen, stops, used = None, [], []
    for depth in range(max_depth + 1):
        at = held(now.join(edges, ["txid", "vout"], "left").withColumn("depth", F.lit(depth)), f"walk-{depth}")
        reason = F.when(F.col("spender").isNull(), "unspent").when(F.col("mix"), "coinjoin")
        if depth == max_depth:
            reason = reason.otherwise("depth")
        stops.append(at.withColumn("reason", reason).where("reason is not null").select("seed", "txid", "vout", "depth", "reason"))
        ordinary = at.where("spender is not null and not mix")
        used.append(ordinary.select("spender", "seed", "n_in", "n_out", "txid", "vout"))
        seen = at.select("seed", "txid", "vout") if seen is None else seen.unionByName(at.select("seed", "txid", "vout"))
        now = (
            ordinary.where("n_out > 0")
            .select("seed", F.col("spender").alias("txid"), F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("vout"))
            .distinct()
            .join(seen, ["seed", "txid", "vout"], "left_anti")
        )
    frontier, consumed = stops[0], used[0]
    for more, u in zip(stops[1:], used[1:], strict=True):
        frontier, consumed = frontier.unionByName(more), consumed.unionByName(u)
    candidates = (
        consumed.groupBy(F.col("spender").alias("spent_by"), "n_in", "n_out")
        .agg(F.count_distinct("seed").alias("seeds"), F.array_sort(F.collect_set(F.struct("txid", "vout"))).alias("outpoints"))  # at most its inputs
        .where("seeds >= 2").select(F.col("spent_by").alias("txid"), "seeds", "n_in", "n_out", "outpoints")
    )
    return frontier, candidates


def propagate_labels(sigs: DataFrame, seeds: DataFrame, rare: DataFrame | None = None, theta: float = 0.5, min_score: float = 0.1, max_rounds: int = 10_000) -> DataFrame:
    """``(coin, label)``: labels spread from the seeds by overlap of signatures.

    In each round all labels' signatures are built anew from their members, and an open coin takes its best
    label if that beats ``min_score`` and, with several labels, stands out by more than ``theta`` standard
    deviations.  A tie goes to the least label."""
    spark = sigs.sparkSession
    folder = _folder(spark)

    def held(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    sigs = held(sigs, "sigs")
    labels = held(seeds.select("coin", "label"), "labels-0")
    for k in range(1, max_rounds + 1):
        entity = entity_signature(labels, sigs).toDF("label", "ancestor", "ml")
        n_labels = labels.agg(F.count_distinct("label").alias("n_labels"))
        x = sigs.join(labels.select("coin"), "coin", "left_anti").join(entity, "ancestor")
        weight = F.lit(1.0)
        if rare is not None:
            x = x.join(rare, "ancestor", "left")
            weight = rarity_weight(F.coalesce("support", F.lit(1)))
        scores = x.groupBy("coin", "label").agg(F.sum(F.least("mass", "ml") * weight).alias("score"))
        # labels without overlap score 0: they enter the spread by their number, not as rows
        best = (
            scores.groupBy("coin").agg(
                F.max(F.struct("score")).alias("top"), F.min_by("label", F.struct(-F.col("score"), "label")).alias("label"),
                F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"), F.slice(F.reverse(F.array_sort(F.collect_list("score"))), 1, 2).alias("two"),
            ).crossJoin(F.broadcast(n_labels))  # one row
        )
        mean = F.col("s") / F.col("n_labels")
        spread = F.sqrt(F.greatest(F.col("ss") / F.col("n_labels") - mean * mean, F.lit(0.0)))
        second = F.coalesce(F.get("two", F.lit(1)), F.lit(0.0))
        stands_out = F.when(spread > 1e-12, (F.col("top.score") - second) / spread).otherwise(0.0) > theta
        fresh = held(best.where((F.col("top.score") > min_score) & ((F.col("n_labels") < 2) | stands_out)).select("coin", "label"), f"fresh-{k}")
        if fresh.isEmpty():
            return labels
        labels = held(labels.unionByName(fresh), f"labels-{k}")
    raise RuntimeError(f"labels still spread after {max_rounds} rounds")


def propagate_and_refine(clusters: DataFrame, seeds: DataFrame, sigs: DataFrame, fp: DataFrame, rare: DataFrame | None = None) -> DataFrame:
    """``(node, cluster, label)`` of both moves: the clusters (node, cluster) after ``split_clusters``, and the labels
    that ``propagate_labels`` spreads; null where a node has none."""
    rare = rarity(sigs) if rare is None else rare
    split = split_clusters(clusters, sigs, fp, rare)
    labels = propagate_labels(sigs, seeds, rare).toDF("node", "label")
    return split.join(labels, "node", "full_outer").select("node", "cluster", "label")


def split_clusters(clusters: DataFrame, sigs: DataFrame, fp: DataFrame, rare: DataFrame | None = None, refuse_below: float = -2.0, eps: float = 1e-9) -> DataFrame:
    """``(node, cluster)`` after each member without common origins with its cluster's least member, and whose
    features speak against it, became a cluster of its own.  ``fp`` has (a, b, fp) for (least member, member)."""
    anchors = clusters.groupBy("cluster").agg(F.min("node").alias("a"))
    pairs = clusters.join(anchors, "cluster").where("node != a").select("a", F.col("node").alias("b"))
    linked = link_strength(pairs, sigs, rare).join(fp, ["a", "b"])
    gone = linked.where((F.col("link") <= eps) & (F.col("fp") < refuse_below)).select(F.col("b").alias("node"), F.lit(True).alias("gone"))
    return clusters.join(gone, "node", "left").select("node", F.when(F.col("gone"), F.col("node")).otherwise(F.col("cluster")).alias("cluster"))


def holdout(seeds: DataFrame, share: float = 0.3, seed: int = 0) -> DataFrame:
    """``seeds`` with ``hidden``: the least hashes of the coins, a share of them rounded down, but at least one and not
    all (so a single one stays)."""
    total = seeds.agg(F.count("*").alias("__n"))
    x = ranked(seeds, "coin", seed).crossJoin(F.broadcast(total))  # one row
    hide = F.least(F.greatest(F.lit(1), F.floor(F.col("__n") * share)), F.greatest(F.col("__n") - 1, F.lit(0)))
    return x.withColumn("hidden", F.col("rank") <= hide).drop("rank", "__n")
