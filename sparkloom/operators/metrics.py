"""Figures of partitions and scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.hashing import hashed
from sparkloom.operators.shared import stored


def partition_figures(groups: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: clusters, entropy (bits), effective count 2^H, and the largest share; ``groups`` has a row per node."""
    sizes = groups.groupBy(cluster).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return (
        sizes.crossJoin(F.broadcast(total))  # one row
        .agg(
            F.count("*").alias("clusters"),
            F.coalesce(F.sum(-share * F.log2(share)), F.lit(0.0)).alias("entropy"),
            F.coalesce(F.max(share), F.lit(0.0)).alias("largest_share"),
        )
        .select("clusters", "entropy", F.pow(F.lit(2.0), F.col("entropy")).alias("effective_count"), "largest_share")
    )


def adjusted_rand_index(both: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (ari) over nodes with a cluster in each of two partitions; 1 where chance can't be told."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    cells = both.groupBy(a, b).agg(F.count("*").alias("n"))
    same = cells.agg(F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("same"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(
        F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias(name), F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_{name}")
    )
    x = same.crossJoin(side(a, "pa")).crossJoin(side(b, "pb"))  # three rows of totals
    whole = pairs("n_pa")
    expected = F.try_divide(F.col("pa") * F.col("pb"), whole)
    most = (F.col("pa") + F.col("pb")) / 2
    return x.select(
        F.when((whole == 0) | (most == expected), F.lit(1.0)).otherwise((F.col("same") - expected) / (most - expected)).alias("ari")
    )


def auc(scored: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """One row (auc, n_pos, n_neg): P(pos > neg) + P(equal) / 2, exactly; null without either class.

    Scores are first counted by value, so the ranking window runs over distinct values in range partitions
    that are summed beforehand: no task holds them all."""
    counts = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q")
    )
    return auc_of_counts(counts)


def auc_of_counts(counts: DataFrame) -> DataFrame:
    """``auc`` from ``(s, p, q)``: how many positives and negatives have each score."""
    # written once, so that both readers below see the same parts
    ranged = stored(counts.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "auc-parts")
    base = (
        ranged.groupBy("part")
        .agg(F.sum("q").alias("q_part"))
        .withColumn("q_before", F.coalesce(F.sum("q_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("part", "q_before")
    )
    inside = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    x = ranged.withColumn("below", F.coalesce(F.sum("q").over(inside), F.lit(0))).join(F.broadcast(base), "part")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("q_before") + F.col("q") / 2))
    return x.agg(wins.alias("w"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_neg")).select(
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg"
    )


def shuffled(pairs: DataFrame, pos: str, neg: str, key: str, seed: int = 0) -> DataFrame:
    """``(score, positive)`` with the two scores of each row swapped by a coin that its key decides."""
    flip = F.substring(hashed(F.col(key), seed), 1, 1) >= "8"
    both = F.array(
        F.struct(F.when(flip, F.col(neg)).otherwise(F.col(pos)).alias("score"), F.lit(True).alias("positive")),
        F.struct(F.when(flip, F.col(pos)).otherwise(F.col(neg)).alias("score"), F.lit(False).alias("positive")),
    )
    return pairs.select(F.explode(both).alias("x")).select("x.*")


def expected_calibration_error(scored: DataFrame, p: str = "p", label: str = "label", bins: int = 10) -> DataFrame:
    """One row (ece) over equal-width bins, the last of them closed."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    x = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))
    gap = F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))
    return x.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def poisson_steps(most: int = 14) -> list[float]:
    """The distribution function of a Poisson variable of mean 1, up to where the hash's digits end."""
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(1, most + 1):
        total += term
        steps.append(total)
        term /= k
    return [x for x in steps if x < 1 - 2.0**-33]


def bootstrap_rates(flags: DataFrame, columns: list[str], rounds: int = 2000, seed: int = 0, key: str = "txid") -> DataFrame:
    """``(name, low, mid, high)``: 95 % intervals of means by a Poisson bootstrap whose draws a row's key decides."""
    draw = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    h = hashed(F.concat_ws("|", F.col(key).cast("string"), F.col("round").cast("string")), seed)
    u = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") + 0.5) / float(1 << 32)
    weight = F.lit(0)
    for step in poisson_steps():
        weight = weight + F.when(u > step, 1).otherwise(0)
    x = flags.select(key, *columns, draw.alias("round")).withColumn("w", weight)
    means = x.groupBy("round").agg(*(F.try_divide(F.sum(F.col("w") * F.col(c).cast("double")), F.sum("w")).alias(c) for c in columns))
    long = means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in columns))).alias("x"))
    return long.groupBy(F.col("x.name").alias("name")).agg(
        F.percentile("x.v", F.lit(0.025)).alias("low"), F.percentile("x.v", F.lit(0.5)).alias("mid"), F.percentile("x.v", F.lit(0.975)).alias("high")
    )
