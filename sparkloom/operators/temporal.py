"""Schedules of activity: hour histograms, their distance, and whether they identify an owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.hashing import hashed, neighbours
from sparkloom.operators.metrics import auc
from sparkloom.operators.shared import stored


def active_hours(rows: DataFrame, entity: str, seconds: str) -> DataFrame:
    """``(entity, hours)``: 24 counts per entity in UTC; null times are skipped."""
    hour = F.pmod(F.floor(F.col(seconds) / 3600), F.lit(24)).cast("int")
    counted = rows.where(F.col(seconds).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(*(F.count_if(hour == h).alias(f"h{h}") for h in range(24)))
    return counted.select("entity", F.array(*(F.col(f"h{h}") for h in range(24))).alias("hours"))


def schedule_distance(a: Column, b: Column) -> Column:
    """Half the absolute difference of two normalised histograms; 0 if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    sa, sb = total(a), total(b)
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(F.try_divide(x, sa) - F.try_divide(y, sb))), F.lit(0.0), lambda s, v: s + v)
    return F.when((sa == 0) | (sb == 0), 0.0).otherwise(gap / 2)


def recurring(rows: DataFrame, entity: str, seconds: str, least: int = 8, most: int | None = None) -> DataFrame:
    """``(entity, times)`` of entities with ``least`` to ``most`` times, in order."""
    x = rows.groupBy(F.col(entity).alias("entity")).agg(F.array_sort(F.collect_list(seconds)).alias("times"))
    fits = F.size("times") >= least
    return x.where(fits if most is None else fits & (F.size("times") <= most))


def halves(rows: DataFrame, entity: str, seconds: str, least: int = 8, seed: int | None = None) -> DataFrame:
    """``(entity, first, second)``: hour histograms of both halves, by time or, given a seed, by a hash."""
    drawn = hashed(F.concat_ws("|", F.col(entity).cast("string"), F.col(seconds).cast("string")), seed or 0)
    order = [F.col(seconds)] if seed is None else [drawn, F.col(seconds)]
    w = Window.partitionBy(entity)
    x = (
        rows.where(F.col(seconds).isNotNull())
        .withColumn("n", F.count("*").over(w))
        .where(F.col("n") >= least)
        .withColumn("k", F.row_number().over(w.orderBy(*order)))
        .withColumn("early", F.col("k") <= F.floor(F.col("n") / 2))
    )
    hour = F.pmod(F.floor(F.col(seconds) / 3600), F.lit(24)).cast("int")
    counts = x.groupBy(F.col(entity).alias("entity")).agg(
        *(F.count_if(F.col("early") & (hour == h)).alias(f"a{h}") for h in range(24)), *(F.count_if(~F.col("early") & (hour == h)).alias(f"b{h}") for h in range(24))
    )
    return counts.select("entity", F.array(*(F.col(f"a{h}") for h in range(24))).alias("first"), F.array(*(F.col(f"b{h}") for h in range(24))).alias("second"))


def calibrate(rows: DataFrame, entity: str, seconds: str, least: int = 8, seed: int = 0) -> DataFrame:
    """One row (baseline_auc, persistence_auc, matched_auc): do two halves of an entity match better than two
    entities?  By hashed halves, halves in time, and against entities with as many active hours.

    Each entity is compared with its neighbour in a hashed order (within its number of active hours, for the
    matched figure), so the comparisons grow with the entities and not with their square."""
    hours = active_hours(rows, entity, seconds)
    whole = stored(
        hours.join(halves(rows, entity, seconds, least).select("entity"), "entity", "left_semi").withColumn("band", F.size(F.filter("hours", lambda h: h > 0))), "schedules"
    )
    score = lambda a, b: F.round(-schedule_distance(F.col(a), F.col(b)), 9).alias("score")

    def negatives(within: list[str]) -> DataFrame:
        x = neighbours(whole.select("entity", "hours", "band"), "entity", seed, within)
        other = whole.select(F.col("entity").alias("other"), F.col("hours").alias("theirs"))
        return x.join(other, "other").select(score("hours", "theirs"), F.lit(False).alias("positive"))

    def positives(seed_: int | None) -> DataFrame:
        return halves(rows, entity, seconds, least, seed_).select(score("first", "second"), F.lit(True).alias("positive"))

    spread = negatives([])
    figure = lambda pos, neg, name: auc(pos.unionByName(neg)).select(F.col("auc").alias(name))
    out = figure(positives(seed), spread, "baseline_auc")
    out = out.crossJoin(figure(positives(None), spread, "persistence_auc"))  # single rows
    return out.crossJoin(figure(positives(None), negatives(["band"]), "matched_auc"))
