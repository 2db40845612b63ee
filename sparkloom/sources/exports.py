"""Readers of transaction exports: JSON lines, wrapped rows, lists, label files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.hashing import hashed
from sparkloom.operators.measure import first_wins

_PREV = "struct<value: string, scriptpubkey_type: string, scriptpubkey_address: string>"
#: All leaves are text: exports write 64-bit integers as strings.
RAW = (
    "txid string, height string, version string, locktime string, fee string, weight string, "
    f"vin array<struct<txid: string, vout: string, sequence: string, value: string, prevout: {_PREV}, witness: array<string>, scriptsig: string, script_hex: string, coinbase: string, is_coinbase: boolean>>, "
    "vout array<struct<value: string, scriptpubkey: string, scriptpubkey_type: string, scriptpubkey_address: string>>, "
    "status struct<block_height: string, block_time: string>, _bc struct<prev_min: double, prev_time: string, incl_time: string>"
)


def _int(c: Column, kind: str = "bigint") -> Column:
    return c.try_cast(kind)


def coerce(raw: DataFrame) -> DataFrame:
    """Integers from text; what isn't one becomes null.  An input's own value stands in for a missing previous one."""

    def vin(v: Column) -> Column:
        value = F.coalesce(_int(v["prevout"]["value"]), _int(v["value"]))
        return F.struct(
            v["txid"].alias("txid"),
            _int(v["vout"], "int").alias("vout"),
            _int(v["sequence"]).alias("sequence"),
            F.struct(value.alias("value"), v["prevout"]["scriptpubkey_type"].alias("scriptpubkey_type"), v["prevout"]["scriptpubkey_address"].alias("scriptpubkey_address")).alias("prevout"),
            F.coalesce(v["witness"], F.array().cast("array<string>")).alias("witness"),
            v["scriptsig"].alias("scriptsig"),
            F.coalesce(v["is_coinbase"], F.lit(False)).alias("is_coinbase"),
            F.coalesce(v["script_hex"], v["scriptsig"], v["coinbase"]).alias("coinbase_script"),
        )

    def vout(o: Column) -> Column:
        return F.struct(_int(o["value"]).alias("value"), o["scriptpubkey"].alias("scriptpubkey"), o["scriptpubkey_type"].alias("scriptpubkey_type"), o["scriptpubkey_address"].alias("scriptpubkey_address"))

    return raw.select(
        "txid",
        F.coalesce(_int(F.col("height")), _int(F.col("status.block_height"))).alias("height"),
        _int(F.col("version"), "int").alias("version"),
        _int(F.col("locktime")).alias("locktime"),
        _int(F.col("fee")).alias("fee"),
        _int(F.col("weight")).alias("weight"),
        F.transform(F.coalesce("vin", F.array().cast(raw.schema["vin"].dataType)), vin).alias("vin"),
        F.transform(F.coalesce("vout", F.array().cast(raw.schema["vout"].dataType)), vout).alias("vout"),
        F.struct(_int(F.col("status.block_height")).alias("block_height"), _int(F.col("status.block_time")).alias("block_time")).alias("status"),
        F.when(
            F.col("_bc").isNotNull(),
            F.struct(F.col("_bc.prev_min").alias("prev_min"), _int(F.col("_bc.prev_time")).alias("prev_time"), _int(F.col("_bc.incl_time")).alias("incl_time")),
        ).alias("_bc"),
        *(c for c in raw.columns if c in ("__file", "__pos")),
    )


def read_export(spark: SparkSession, *paths: str) -> DataFrame:
    """Transactions from JSON lines, or files that hold one list, on one line or many; what is wrapped in ``row`` is
    unwrapped.  A file whose first sign is ``[`` is read whole, as one row; the others line by line."""
    struct = f"struct<row: string, {RAW.replace(': ', ':')}>"
    found = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__pos"))
    firsts = found.where(F.trim("value") != "").groupBy("__file").agg(F.min_by(F.trim("value"), "__pos").alias("first"))
    whole = [r["__file"] for r in firsts.where(F.col("first").startswith("[")).select("__file").collect()]  # names of files
    lines = found.where(~F.col("__file").isin(whole)) if whole else found
    x = lines.where(F.trim("value") != "").select(F.from_json(F.trim("value"), struct).alias("t"), "__file", "__pos")
    if whole:
        texts = spark.read.text([unquote(p) for p in whole], wholetext=True).select("value", F.col("_metadata.file_path").alias("__file"))
        lists = texts.select(F.posexplode(F.from_json("value", f"array<{struct}>")).alias("__pos", "t"), "__file")
        x = x.unionByName(lists.select("t", "__file", F.col("__pos").cast("bigint").alias("__pos")))
    wrapped = F.from_json("t.row", f"struct<{RAW.replace(': ', ':')}>")
    names = [f.strip().split(" ")[0] for f in ("txid", "height", "version", "locktime", "fee", "weight", "vin", "vout", "status", "_bc")]
    flat = x.withColumn("w", wrapped).select(
        *(F.when(F.col("t.row").isNotNull(), F.col(f"w.{n}")).otherwise(F.col(f"t.{n}")).alias(n) for n in names), "__file", "__pos"
    )
    return coerce(flat)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, a folder or a pattern stands for, by name."""
    return sorted(r[0] for r in spark.read.text(path).select("_metadata.file_path").distinct().collect())


def load_unique(spark: SparkSession, *paths: str, keep: Column | None = None) -> DataFrame:
    """The first transaction of each id over all files, in the order in which they are given (those of one folder or
    pattern by their full names); ``keep`` is applied before."""
    x = read_export(spark, *paths)
    if keep is not None:
        x = x.where(keep)
    order: dict[str, int] = {}
    for p in paths:
        for f in _files(spark, p):
            order.setdefault(f, len(order))
    places = spark.createDataFrame(list(order.items()), "__file string, __place int")  # a row per file
    return first_wins(x.join(F.broadcast(places), "__file"), "txid", "__place", "__pos").drop("__place", "__file", "__pos")


def witness_sample(txs: DataFrame) -> DataFrame:
    """Transactions with inputs, none of them a coinbase or without its previous output."""
    known = F.forall("vin", lambda v: ~F.coalesce(v["is_coinbase"], F.lit(False)) & v["prevout"]["value"].isNotNull())
    return first_wins(txs.where((F.size("vin") > 0) & known), "txid", "height")


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """``(key, entity, kind, source, confidence)``; blank lines and comments are skipped, the last of a key wins."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    x = lines.where("line != '' and not startswith(line, '#')").select(
        F.from_json("line", "key string, entity string, kind string, source string, confidence double").alias("r"), "at"
    ).where("r.key is not null")
    last = x.groupBy(F.col("r.key").alias("k")).agg(F.max_by("r", "at").alias("r"))
    return last.select("r.*")


def uniform_sample(txs: DataFrame, n_blocks: int, per_block: int, seed: int = 0, floor: int = 0) -> DataFrame:
    """A few transactions of a few blocks, chosen by hashes: the same rows on every run and at every partitioning."""
    heights = txs.where(F.col("height") >= floor).select("height").distinct().orderBy(hashed(F.col("height"), seed), "height").limit(n_blocks)
    order = Window.partitionBy("height").orderBy(hashed(F.col("txid"), seed), "txid")
    return txs.join(heights, "height", "left_semi").withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= per_block).drop("__k")


def recent_sample(txs: DataFrame, n_blocks: int = 15) -> DataFrame:
    """Transactions of the latest blocks, coinbases left out."""
    tip = txs.agg(F.max("height").alias("tip"))
    first_coinbase = F.coalesce(F.get("vin", F.lit(0))["is_coinbase"], F.lit(False))
    return txs.crossJoin(F.broadcast(tip)).where((F.col("height") > F.col("tip") - n_blocks) & ~first_coinbase).drop("tip")  # one row


def era(height: Column) -> Column:
    """Script era of a height."""
    return F.when(height < 481824, "pre_segwit").when(height < 709632, "segwit").otherwise("taproot")


# Script types as a chain table names them, and as the axes do.
CHAIN_TYPES = {
    "pubkeyhash": "p2pkh", "scripthash": "p2sh", "witness_v0_keyhash": "v0_p2wpkh", "witness_v0_scripthash": "v0_p2wsh",
    "witness_v1_taproot": "v1_p2tr", "pubkey": "p2pk", "multisig": "multisig", "nulldata": "op_return",
}


def _chain_type(kind: Column) -> Column:
    named = F.coalesce(*(F.when(kind == a, F.lit(b)) for a, b in CHAIN_TYPES.items()))
    return F.coalesce(named, kind)


def chain_rows(chain: DataFrame, values: bool = True, types: bool = True) -> DataFrame:
    """Transactions from a chain table (hash, block_number, version, lock_time, fee, virtual_size, inputs, outputs):
    only the asked nested fields are read, first addresses stand for all."""

    def side(x: Column) -> list[Column]:
        out = [F.get(x["addresses"], F.lit(0)).alias("scriptpubkey_address")]
        if types:
            out.insert(0, _chain_type(x["type"]).alias("scriptpubkey_type"))
        if values:
            out.insert(0, x["value"].alias("value"))
        return out

    vin = F.transform(
        "inputs", lambda i: F.struct(i["spent_transaction_hash"].alias("txid"), i["spent_output_index"].alias("vout"), i["sequence"].alias("sequence"), F.struct(*side(i)).alias("prevout"))
    )
    vout = F.transform("outputs", lambda o: F.struct(*([] if values else [o["value"].alias("value")]), *side(o)))
    more = [F.col("fee"), (F.col("virtual_size") * 4).alias("weight")] if types else []
    return chain.where("not is_coinbase").select(
        F.col("hash").alias("txid"), F.col("block_number").alias("height"), "version", F.col("lock_time").alias("locktime"), *more, vin.alias("vin"), vout.alias("vout")
    )


def export_sample(chain: DataFrame, percent: float, seed: int = 0, limit: int | None = None) -> DataFrame:
    """``(txid, height, row)`` of a hashed share of the chain; row is the transaction as JSON.  With ``limit``, the
    least hashes of those."""
    cut = f"{int(percent / 100 * (1 << 32)):08x}"
    x = chain.where(F.substring(hashed(F.col("hash"), seed), 1, 8) < cut)
    if limit is not None:
        x = x.orderBy(hashed(F.col("hash"), seed), "hash").limit(limit)
    rows = chain_rows(x)
    return rows.select("txid", "height", F.to_json(F.struct(*rows.columns)).alias("row"))


def contiguous_slice(chain: DataFrame, first_day: str, last_day: str, values: bool = False) -> DataFrame:
    """Every transaction of a range of days (column day, by which the table is partitioned, so others are not read)."""
    return chain_rows(chain.where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))), values=values, types=False)


def graph_slice(chain: DataFrame, month: str, low: int, high: int) -> DataFrame:
    """``(txid, height, sources, targets)``: first addresses only, of a range of blocks; ``month`` prunes partitions."""
    x = chain.where((F.col("month") == F.lit(month).cast("date")) & F.col("block_number").between(low, high) & ~F.col("is_coinbase"))
    first = lambda side: F.transform(side, lambda i: F.get(i["addresses"], F.lit(0)))
    return x.select(F.col("hash").alias("txid"), F.col("block_number").alias("height"), first("inputs").alias("sources"), first("outputs").alias("targets"))


def cospend_times(chain: DataFrame, month: str, least: int = 8, most: int = 200, limit: int | None = None) -> DataFrame:
    """``(addr, times)``: block times in order of the least input address, as the owner, of a month's transactions;
    with ``limit``, the least addresses of those."""
    least_address = F.array_min(F.flatten(F.transform("inputs", lambda i: F.coalesce(i["addresses"], F.array().cast("array<string>")))))
    x = chain.where((F.col("month") == F.lit(month).cast("date")) & ~F.col("is_coinbase")).select(least_address.alias("addr"), "seconds").where("addr is not null")
    # the bound is tested on counts, so no list grows beyond it
    fits = x.groupBy("addr").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    if limit is not None:
        fits = fits.orderBy("addr").limit(limit)
    return x.join(fits.select("addr"), "addr", "left_semi").groupBy("addr").agg(F.array_sort(F.collect_list("seconds")).alias("times"))
