"""What conservation of amounts forces onto a known participant of a round, and who descends from whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import amounts

FEE_CAP = 2000


def _totals(txs: DataFrame) -> DataFrame:
    return txs.withColumn(
        "total", F.aggregate("vin", F.lit(0).cast("long"), lambda s, v: s + F.coalesce(v["prevout"]["value"], F.lit(0)))
    )


def forced_in_round(txs: DataFrame, known: str = "known", min_count: int = 1) -> DataFrame:
    """``(txid, value, forced, present, slack)`` of the output values that are forced; ``known`` is a column."""
    counted = (
        _totals(txs)
        .select("txid", "total", F.col(known).alias("known"), F.explode("vout").alias("o"))
        .groupBy("txid", "total", "known", F.col("o.value").alias("value"))
        .agg(F.count("*").alias("present"))
    )
    args = (F.col("total"), F.col("known"), F.col("value"), F.col("present"))
    return (
        counted.withColumn("forced", amounts.forced_count(*args))
        .where(F.col("forced") >= min_count)
        .select("txid", "value", "forced", "present", amounts.slack(*args).alias("slack"))
    )


def forced_prefixes(txs: DataFrame, known: str = "known") -> DataFrame:
    """``(txid, depth, value, forced_amount, coins, pool)``: the bound over the largest values, pooled.

    A row per prefix of the distinct values, largest first; ``coins`` is the fewest outputs that cover it."""
    counted = (
        _totals(txs)
        .select("txid", "total", F.col(known).alias("known"), F.explode("vout").alias("o"))
        .groupBy("txid", "total", "known", F.col("o.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    down = Window.partitionBy("txid").orderBy(F.desc("value"))
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    pooled = counted.select(
        "txid",
        F.row_number().over(down).cast("long").alias("depth"),
        "value",
        F.sum(F.col("value") * F.col("n")).over(upto).alias("pooled"),
        F.sum("n").over(upto).alias("pool"),
        "n",
        amounts.others_input(F.col("total"), F.col("known")).alias("others"),
    ).withColumn("forced_amount", F.col("pooled") - F.col("others"))
    forced = pooled.where("forced_amount > 0").select("txid", "depth", "value", "forced_amount", "pool")
    # take the largest first: all of those before the one step whose sum covers the amount, and of it as many as needed
    steps = pooled.select("txid", F.col("value").alias("v"), (F.col("pooled") - F.col("value") * F.col("n")).alias("under"), "pooled", (F.col("pool") - F.col("n")).alias("held"))
    met = forced.join(steps, "txid").where((F.col("forced_amount") > F.col("under")) & (F.col("forced_amount") <= F.col("pooled")))
    coins = F.col("held") + F.ceil(F.try_divide(F.col("forced_amount") - F.col("under"), F.col("v"))).cast("long")
    return met.select("txid", "depth", "value", "forced_amount", coins.alias("coins"), "pool")


def coinjoin_demix(txs: DataFrame, fee_cap: int = FEE_CAP) -> DataFrame:
    """``(txid, input_index, change)``: inputs matched with one change output by mix + change - fee.

    The mix is the most common output value (the first of several), at least three times; a match must be
    unique on both sides."""
    outs = txs.select("txid", F.posexplode("vout").alias("pos", "o")).select("txid", "pos", F.col("o.value").alias("value"))
    mixes = (
        outs.groupBy("txid", "value")
        .agg(F.count("*").alias("n"), F.min("pos").alias("first"))
        .groupBy("txid")
        .agg(F.max(F.struct("n", -F.col("first"), "value")).alias("m"))
        .select("txid", F.col("m.value").alias("mix"), F.col("m.n").alias("n"))
        .where("n >= 3")
    )
    changes = outs.join(mixes, "txid").where("value != mix").select("txid", "pos", "value", "mix")
    ins = txs.select("txid", F.posexplode("vin").alias("input_index", "v")).select("txid", "input_index", F.col("v.prevout.value").alias("paid"))
    fee = F.col("mix") + F.col("value") - F.col("paid")
    # only amounts within a fee of each other meet: those of one step of the fee's size, or of the next
    step = lambda amount: F.floor(amount / fee_cap)
    near = ins.withColumn("step", F.explode(F.array(step(F.col("paid")), step(F.col("paid")) + 1)))
    valid = near.join(changes.withColumn("step", step(F.col("mix") + F.col("value"))), ["txid", "step"]).where((fee > 0) & (fee <= fee_cap))
    by_input, by_change = Window.partitionBy("txid", "input_index"), Window.partitionBy("txid", "value")
    return (
        valid.withColumn("a", F.count("*").over(by_input))
        .withColumn("b", F.count("*").over(by_change))
        .where("a = 1 and b = 1")
        .select("txid", F.col("input_index").cast("long").alias("input_index"), F.col("value").alias("change"))
    )


def descended_inputs(txs: DataFrame, known: DataFrame) -> DataFrame:
    """``(txid, index, funder, vout, value)`` of the inputs whose funder is in ``known`` (column txid)."""
    ins = txs.select("txid", F.posexplode("vin").alias("index", "v"))
    flat = ins.select("txid", F.col("index").cast("long").alias("index"), F.col("v.txid").alias("funder"), F.col("v.vout").alias("vout"), F.col("v.prevout.value").alias("value"))
    return flat.join(known.select(F.col("txid").alias("funder")).distinct(), "funder", "left_semi").select("txid", "index", "funder", "vout", "value")


def rank_by_overlap(txs: DataFrame, known: DataFrame) -> DataFrame:
    """``(txid, descended, total, share)`` of the transactions with inputs."""
    inside = descended_inputs(txs, known).groupBy("txid").agg(F.count("*").alias("descended"))
    return (
        txs.where(F.size("vin") > 0)
        .select("txid", F.size("vin").cast("long").alias("total"))
        .join(inside, "txid", "left")
        .select("txid", F.coalesce("descended", F.lit(0)).alias("descended"), "total")
        .withColumn("share", F.col("descended") / F.col("total"))
    )


def candidate_coins(txs: DataFrame, known: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """``(txid, value, script_type, n)`` of descended inputs, without one copy of the anchor's value.

    ``anchor`` has (txid, anchor_value)."""
    ins = txs.select("txid", F.posexplode("vin").alias("index", "v")).select(
        "txid", "index", F.col("v.txid").alias("funder"), F.col("v.prevout.value").alias("value"), F.col("v.prevout.scriptpubkey_type").alias("script_type")
    )
    found = ins.join(known.select(F.col("txid").alias("funder")).distinct(), "funder", "left_semi").where("value is not null")
    if anchor is not None:
        order = Window.partitionBy("txid", "value").orderBy("index")
        found = (
            found.join(anchor, "txid", "left")
            .withColumn("k", F.row_number().over(order))
            .where("anchor_value is null or value != anchor_value or k > 1")
        )
    return found.groupBy("txid", "value", "script_type").agg(F.count("*").alias("n"))
