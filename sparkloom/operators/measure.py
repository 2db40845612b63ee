"""Value shares, evidence bits and entropy of the axes over a sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.axes import AXES


def measure(txs: DataFrame, named: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """``(axis, value, n, p, bits)``; one scan and one shuffle on (axis, value)."""
    named = AXES if named is None else named
    long = txs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), f().alias("value")) for k, f in named.items()))).alias("x"))
    counts = long.select("x.axis", "x.value").groupBy("axis", "value").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("axis"))
    return counts.withColumn("p", share).withColumn("bits", -F.log2("p"))


def entropy(measured: DataFrame) -> DataFrame:
    """``(axis, total, entropy_bits)``."""
    return measured.groupBy("axis").agg(F.sum("n").alias("total"), F.sum(F.col("p") * F.col("bits")).alias("entropy_bits"))


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order; rows without a key are dropped."""
    by = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
