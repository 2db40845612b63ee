"""Choices by hash: partners and ranks that are the same on every run, at every partitioning, and in SQL.

The hash is md5 over ``salt|key`` as text.  Its first three digits cut the rows into 4096 parts, so no window holds
more than about a four-thousandth of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_DIGITS = 3


def hashed(key: Column, salt: str | int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}|"), key.cast("string")).cast("binary"))


def neighbours(rows: DataFrame, key: str, salt: str | int = 0, within: list[str] | None = None) -> DataFrame:
    """``rows`` with ``other``, the key that follows in hashed order, within a part and the given columns; the last
    of each has none and is dropped."""
    h = hashed(F.col(key), salt)
    parts = [F.substring(h, 1, PART_DIGITS), *map(F.col, within or [])]
    order = Window.partitionBy(*parts).orderBy(h, key)
    return rows.withColumn("other", F.lead(key).over(order)).where("other is not null")


def ranked(rows: DataFrame, key: str, salt: str | int = 0) -> DataFrame:
    """``rows`` with ``rank``, from 1 on in hashed order over all rows: the parts' sizes are added up, then each part
    is ranked by itself."""
    h = rows.withColumn("__h", hashed(F.col(key), salt)).withColumn("__part", F.substring("__h", 1, PART_DIGITS))
    sizes = h.groupBy("__part").agg(F.count("*").alias("__n"))  # at most 4096 rows
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__h", key))
    return h.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn("rank", F.col("__before") + inside).drop("__h", "__part", "__before")
