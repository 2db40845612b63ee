"""Evidence of a pair in bits: agreement on a rare value counts for, disagreement against.

An axis abstains by its policy; agreement on a value that was never measured says nothing; disagreement never
counts for.  ``c`` is the chance that one owner keeps a value, one number or one per axis.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import axes, library


@dataclass(frozen=True)
class Axis:
    name: str
    shares: dict[str, float]
    collision: float
    #: values that make the axis abstain if either side has one
    silent: frozenset[str] = field(default_factory=frozenset)
    #: abstain if neither side's value was measured
    silent_if_unknown: bool = False

    def mismatch_bits(self, c: float) -> float:
        return min(0.0, math.log2((1 - c) / max(1 - self.collision, 1e-6)))


def axis_of(name: str, shares: dict[str, float], **policy) -> Axis:
    return Axis(name, shares, sum(p * p for p in shares.values()), **policy)


def narrow_axes() -> list[Axis]:
    """The three axes of the clustering engine, from the library."""
    lock = library.shares("locktime")
    height = sum(p for v, p in lock.items() if v != "zero")
    return [
        axis_of("nsequence", library.shares("nsequence")),
        axis_of("locktime", {"zero": lock.get("zero", 0.5), "height": height or 0.5}),
        axis_of("in_order", library.shares("input_order"), silent=frozenset(("single", "small_n"))),
    ]


NARROW = {"nsequence": axes.nsequence, "locktime": axes.locktime_policy, "in_order": axes.input_order}


def wide_axes() -> list[Axis]:
    """All library axes; heights of the lock time are folded into one value."""
    out = []
    for name in library.BITS:
        shares = library.shares(name)
        if name == "locktime":
            fold: dict[str, float] = {}
            for v, p in shares.items():
                key = "height" if v.startswith("height") else v
                fold[key] = fold.get(key, 0.0) + p
            shares = fold
        out.append(axis_of(name, shares, silent_if_unknown=True))
    return out


def folded_locktime() -> Column:
    kind = axes.locktime_class()
    return F.when(kind.startswith("height"), "height").otherwise(kind)


WIDE = {**{k: v for k, v in axes.AXES.items()}, "locktime": folded_locktime}


def axis_weight(axis: Axis, a: Column, b: Column, c: float = 0.95) -> Column:
    """Bits of one axis, null where it says nothing."""
    known = F.coalesce(*(F.when(a == v, F.lit(-math.log2(p))) for v, p in axis.shares.items()), F.lit(None).cast("double"))
    quiet = F.lit(False)
    if axis.silent:
        quiet = a.isin(*axis.silent) | b.isin(*axis.silent)
    if axis.silent_if_unknown and axis.shares:
        quiet = quiet | ~(a.isin(*axis.shares) | b.isin(*axis.shares))
    return F.when(quiet, F.lit(None).cast("double")).when(a == b, known).otherwise(F.lit(axis.mismatch_bits(c)))


def score(pair_axes: list[Axis], a: str, b: str, c: float | dict[str, float] = 0.95) -> Column:
    """Total bits of two struct columns that hold a value per axis; axes are added in order."""
    total = F.lit(0.0)
    for axis in pair_axes:
        cj = c[axis.name] if isinstance(c, dict) else c
        total = total + F.coalesce(axis_weight(axis, F.col(f"{a}.{axis.name}"), F.col(f"{b}.{axis.name}"), cj), F.lit(0.0))
    return total


def explain(pair_axes: list[Axis], a: str, b: str, c: float = 0.95) -> Column:
    """A row per axis: its name, both values and its bits."""
    return F.array(
        *(
            F.struct(
                F.lit(x.name).alias("axis"),
                F.col(f"{a}.{x.name}").alias("a"),
                F.col(f"{b}.{x.name}").alias("b"),
                axis_weight(x, F.col(f"{a}.{x.name}"), F.col(f"{b}.{x.name}"), c).alias("bits"),
            )
            for x in pair_axes
        )
    )


def features(named: dict) -> Column:
    """The values of the named axes of the current row, as one struct."""
    return F.struct(*(build().alias(name) for name, build in named.items()))


def fitted(measured: DataFrame, c: float = 0.95) -> DataFrame:
    """``(axis, total, n_values, collision, mismatch_bits)``: a scorer's parameters from a sample's own value shares
    (axis, n, p), in place of the library's."""
    x = measured.groupBy("axis").agg(F.sum("n").alias("total"), F.count("*").alias("n_values"), F.sum(F.col("p") * F.col("p")).alias("collision"))
    miss = F.least(F.lit(0.0), F.log2(F.lit(1 - c) / F.greatest(1 - F.col("collision"), F.lit(1e-6))))
    return x.withColumn("mismatch_bits", miss)


def axes_of(measured: DataFrame, names: dict) -> list[Axis]:
    """Axes with the value shares of a sample (axis, value, p), which has a row per measured value."""
    shares: dict[str, dict[str, float]] = {k: {} for k in names}
    for r in measured.where(F.col("axis").isin(*names)).collect():
        shares[r["axis"]][r["value"]] = r["p"]
    return [axis_of(k, v, silent_if_unknown=True) for k, v in shares.items()]
