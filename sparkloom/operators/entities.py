"""Entity detectors: labels that a transaction's own structure gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUST = 1000
# Vanity prefixes and the number of addresses that share one by chance.
BITMEX_SPACE = {"3BMEX": 58**4, "bc1qmex": 32**3}
DICE_PREFIX = "1dice"
# Pool tags in order of precedence.
POOL_TAGS = {
    "antpool": "antpool",
    "f2pool": "f2pool",
    "viabtc": "viabtc",
    "slush": "slushpool",
    "braiins": "slushpool",
    "btc.com": "btccom",
    "poolin": "poolin",
    "1thash": "1thash",
    "58coin": "58coin",
    "huobi": "huobipool",
    "okpool": "okpool",
    "okex": "okexpool",
    "binance": "binancepool",
    "foundry": "foundryusa",
    "/mara": "marapool",
    "spiderpool": "spiderpool",
    "emcd": "emcd",
    "luxor": "luxor",
    "sbicrypto": "sbicrypto",
    "ultimuspool": "ultimuspool",
    "secpool": "secpool",
    "rawpool": "rawpool",
    "bytepool": "bytepool",
    "whitepool": "whitepool",
}


def op_return_length(script: Column) -> Column:
    """Bytes pushed by a single-push OP_RETURN script (hex), else null."""
    raw = F.when(script.rlike("^([0-9a-fA-F]{2})+$"), F.lower(script))
    size = F.length(raw) / 2
    byte = lambda i: F.conv(F.substring(raw, 2 * i + 1, 2), 16, 10).cast("long")
    op = byte(1)
    n = F.when(op.between(1, 75), op).when((op == 76) & (size >= 3), byte(2)).when((op == 77) & (size >= 4), byte(2) + 256 * byte(3))
    head = F.when(op.between(1, 75), 2).when(op == 76, 3).when(op == 77, 4)
    return F.when((F.substring(raw, 1, 2) == "6a") & (size >= 2) & (size == head + n), n)


def notification_address() -> Column:
    """Payee of a payment-code notification: exactly one 80-byte OP_RETURN and a payment; else null."""
    is_note = lambda o: F.coalesce(op_return_length(o["scriptpubkey"]) == 80, F.lit(False))
    pays = F.filter("vout", lambda o: ~is_note(o) & ~F.coalesce(o["scriptpubkey_type"] == "op_return", F.lit(False)))
    return F.when((F.size(F.filter("vout", is_note)) == 1) & (F.size(pays) > 0), F.get(pays, F.lit(0))["scriptpubkey_address"])


def _space(address: Column) -> Column:
    return F.coalesce(*(F.when(address.startswith(p), F.lit(n)) for p, n in BITMEX_SPACE.items()))


def addresses(txs: DataFrame) -> DataFrame:
    """``(txid, role, index, address)`` of all non-null addresses."""
    outs = txs.select("txid", F.posexplode("vout").alias("index", "o")).select("txid", F.lit("output").alias("role"), F.col("index").cast("long").alias("index"), F.col("o.scriptpubkey_address").alias("address"))
    ins = txs.select("txid", F.posexplode("vin").alias("index", "v")).select("txid", F.lit("input").alias("role"), F.col("index").cast("long").alias("index"), F.col("v.prevout.scriptpubkey_address").alias("address"))
    return outs.unionByName(ins).where("address is not null")


def _address_array() -> Column:
    outs = F.transform("vout", lambda o, i: F.struct(F.lit("output").alias("role"), i.cast("long").alias("index"), o["scriptpubkey_address"].alias("address")))
    ins = F.transform("vin", lambda v, i: F.struct(F.lit("input").alias("role"), i.cast("long").alias("index"), v["prevout"]["scriptpubkey_address"].alias("address")))
    return F.filter(F.concat(outs, ins), lambda x: F.coalesce(x["address"], F.lit("")) != "")


def detect_bitmex(txs: DataFrame) -> DataFrame:
    """``(txid, role, index, address, confidence, expected_collisions)``; a prefix is worth its improbability."""
    found = txs.select("txid", _address_array().alias("all")).select("txid", F.size("all").alias("scanned"), F.explode("all").alias("x"))
    expected = F.col("scanned") / _space(F.col("x.address"))
    return found.where(_space(F.col("x.address")).isNotNull()).select(
        "txid", "x.role", "x.index", "x.address", F.round(0.98 / (1 + expected), 4).alias("confidence"), expected.alias("expected_collisions")
    )


def detect_satoshidice(txs: DataFrame) -> DataFrame:
    found = txs.select("txid", F.explode(_address_array()).alias("x"))
    return found.where(F.col("x.address").startswith(DICE_PREFIX)).select("txid", "x.role", "x.index", "x.address", F.lit(0.97).alias("confidence"))


def _dust() -> Column:
    return F.filter("vout", lambda o: o["value"] <= DUST)


def detect_dust_fanout(txs: DataFrame, min_outputs: int = 20, min_share: float = 0.9) -> DataFrame:
    """``(txid, address, value)`` of the dust outputs of a fan-out."""
    fits = (F.size("vout") >= min_outputs) & (F.size(_dust()) >= min_share * F.size("vout"))
    return txs.where(fits).select("txid", F.explode(_dust()).alias("o")).select("txid", F.col("o.scriptpubkey_address").alias("address"), "o.value")


def detect_consolidation(txs: DataFrame, min_inputs: int = 10, max_outputs: int = 2) -> DataFrame:
    n_in, n_out = F.size("vin").cast("long"), F.size("vout").cast("long")
    return txs.where((n_in >= min_inputs) & (n_out <= max_outputs)).select("txid", n_in.alias("n_inputs"), n_out.alias("n_outputs"))


def detect_batching(txs: DataFrame, min_outputs: int = 10, max_dust_share: float = 0.5, min_fanout: int = 4) -> DataFrame:
    n_in, n_out = F.size("vin"), F.size("vout")
    fits = (n_out >= min_outputs) & (n_out >= min_fanout * F.greatest(n_in, F.lit(1))) & (F.size(_dust()) <= max_dust_share * n_out)
    return txs.where(fits).select("txid", n_out.cast("long").alias("n_outputs"))


def mining_pool(script: Column) -> Column:
    """Pool of a coinbase script (hex, or text), by the first tag it holds."""
    text = F.lower(F.when(script.rlike("^([0-9a-fA-F]{2})+$"), F.decode(F.unhex(script), "ISO-8859-1")).otherwise(script))
    return F.coalesce(*(F.when(F.contains(text, F.lit(tag)), F.lit(pool)) for tag, pool in POOL_TAGS.items()))


def detect_mining_pool(txs: DataFrame, coinbase: str) -> DataFrame:
    """``(txid, entity, payout)`` of coinbase transactions; ``coinbase`` names the column of the script, null elsewhere."""
    paid = F.filter("vout", lambda o: o["scriptpubkey_address"].isNotNull() & o["value"].isNotNull())
    best = F.array_max(F.transform(paid, lambda o, i: F.struct(o["value"].alias("v"), (-i).alias("i"), o["scriptpubkey_address"].alias("a"))))["a"]
    return txs.where(F.col(coinbase).isNotNull()).select("txid", mining_pool(F.col(coinbase)).alias("entity"), best.alias("payout")).where("entity is not null")


def entity_labels(txs: DataFrame, coinbase: str | None = None) -> DataFrame:
    """``(txid, detector)`` of all detectors that fire; mining pools too if ``coinbase`` names the column of the script."""
    parts = [
        txs.where(notification_address().isNotNull()).select("txid", F.lit("bip47_notification").alias("detector")),
        *(
            f(txs).select("txid", F.lit(name).alias("detector")).distinct()
            for name, f in (
                ("bitmex", detect_bitmex),
                ("dust_fanout", detect_dust_fanout),
                ("satoshidice", detect_satoshidice),
                ("consolidation", detect_consolidation),
                ("batching", detect_batching),
            )
        ),
    ]
    if coinbase is not None:
        parts.append(detect_mining_pool(txs, coinbase).select("txid", F.lit("mining_pool").alias("detector")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hub_addresses(txs: DataFrame, curated: DataFrame | None = None, coinbase: str | None = None) -> DataFrame:
    """Addresses (column address) of known services, whose counterparties prove nothing; the payouts of mining pools
    too if ``coinbase`` names the column of the script."""
    out = detect_bitmex(txs).select("address").unionByName(detect_satoshidice(txs).select("address"))
    if coinbase is not None:
        out = out.unionByName(detect_mining_pool(txs, coinbase).where("payout is not null").select(F.col("payout").alias("address")))
    if curated is not None:
        out = out.unionByName(curated.where(F.col("kind").isin("supercluster", "service")).select(F.col("key").alias("address")))
    return out.distinct()


def curated_labels(txs: DataFrame, curated: DataFrame) -> DataFrame:
    """``(txid, role, index, address, entity, kind, confidence)`` of addresses on a curated list (column key)."""
    return addresses(txs).join(curated.withColumnRenamed("key", "address"), "address").select(
        "txid", "role", "index", "address", "entity", "kind", "confidence"
    )


def entity_of(found: DataFrame, curated: DataFrame, column: str = "address") -> DataFrame:
    """Entity of each address: the curated one first, then the vanity prefix."""
    named = curated.select(F.col("key").alias(column), F.col("entity").alias("__curated"))
    vanity = F.when(_space(F.col(column)).isNotNull(), "bitmex").when(F.col(column).startswith(DICE_PREFIX), "satoshidice")
    return found.join(named, column, "left").withColumn("entity", F.coalesce("__curated", vanity)).drop("__curated")
