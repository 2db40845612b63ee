"""Construction axes: each turns a nested transaction into one categorical value, as a column expression.

All read the columns version, locktime, height, fee, weight, vin and vout of the current row; missing arrays
count as empty and missing fields as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SEQUENCE, FINAL_SEQUENCE, RBF_SEQUENCE = 4294967295, 4294967294, 4294967293
NO_TIMESTAMP_BELOW = 500_000_000


def roundness(value: Column) -> Column:
    """Trailing decimal zeros of a positive amount, else 0."""
    text = value.cast("string")
    return F.when(value > 0, F.length(text) - F.length(F.rtrim(text, F.lit("0")))).otherwise(F.lit(0))


def _every(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.forall(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True))


def _some(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def _known(items: Column) -> Column:
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull()))


def _one_of(kinds: Column, none: str, prefix: str = "") -> Column:
    """The only kind of a list of distinct kinds; ``none`` if there is none, mixed if there are more."""
    return F.when(F.size(kinds) == 0, none).when(F.size(kinds) > 1, "mixed").otherwise(F.concat(F.lit(prefix), F.get(kinds, F.lit(0))))


def _vin() -> Column:
    return F.col("vin")


def _vout() -> Column:
    return F.col("vout")


def input_types() -> Column:
    return F.transform(_vin(), lambda v: v["prevout"]["scriptpubkey_type"])


def locktime_policy() -> Column:
    return F.when(F.coalesce(F.col("locktime"), F.lit(0)) == 0, "zero").otherwise("height")


def nsequence() -> Column:
    s = F.transform(_vin(), lambda v: v["sequence"])
    rest = F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(1)))
    return (
        F.when((F.size(s) >= 2) & (F.get(s, F.lit(0)) == 1) & _every(rest, lambda x: x == MAX_SEQUENCE), "cake_group_c")
        .when(_some(s, lambda x: x == 1), "seq_0x01_other")
        .when(_every(s, lambda x: x == RBF_SEQUENCE), "rbf_fffffffd")
        .when(_every(s, lambda x: x == FINAL_SEQUENCE), "final_fffffffe")
        .when(_every(s, lambda x: x == MAX_SEQUENCE), "max_ffffffff")
        .otherwise("mixed_other")
    )


def _reversed_bytes(hexed: Column) -> Column:
    """Bytes of a hex text, last first; reverse() on binary would go by characters."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1))), ""))


def internal_txid(txid: Column) -> Column:
    """Bytes of an id in internal order; ids that are no hex keep their text."""
    return F.when(txid.rlike("^([0-9a-fA-F]{2})*$"), _reversed_bytes(txid)).otherwise(F.encode(txid, "utf-8"))


def _order(keys: Column, unsorted: str, sorted_: str) -> Column:
    n = F.size(keys)
    return F.when(n == 1, "single").when(keys != F.array_sort(keys), unsorted).when(n >= 4, sorted_).otherwise("small_n")


def input_order() -> Column:
    return _order(F.transform(_vin(), lambda v: F.struct(internal_txid(v["txid"]).alias("t"), v["vout"].alias("n"))), "shuffle", "bip69")


def output_order() -> Column:
    raw = lambda o: F.coalesce(F.unhex(o["scriptpubkey"]), F.unhex(F.lit("")))
    return _order(F.transform(_vout(), lambda o: F.struct(o["value"].alias("v"), raw(o).alias("s"))), "unsorted", "sorted_value")


def io_shape() -> Column:
    return F.concat(F.size("vin").cast("string"), F.lit("in-"), F.size("vout").cast("string"), F.lit("out"))


def version() -> Column:
    return F.concat(F.lit("v"), F.coalesce(F.col("version").cast("string"), F.lit("None")))


def change_spk_type() -> Column:
    kinds = F.transform(_vout(), lambda o: o["scriptpubkey_type"])
    return F.when(_some(kinds, lambda k: k.isNull()), "ERR").otherwise(
        F.when(F.size(F.array_distinct(kinds)) == 1, F.concat(F.lit("uniform_"), F.get(kinds, F.lit(0)))).otherwise("mixed")
    )


def uih() -> Column:
    known = F.filter(F.transform(_vin(), lambda v: v["prevout"]["value"]), lambda x: x.isNotNull())
    largest = F.array_max(F.transform(_vout(), lambda o: o["value"]))
    return F.when((F.size(known) < 2) | (F.size("vout") == 0), "none").when(F.array_max(known) >= largest, "uih1").otherwise("none")


def _signatures() -> Column:
    """First witness items that aren't empty."""
    return F.filter(F.transform(_vin(), lambda v: F.get(v["witness"], F.lit(0))), lambda s: s.isNotNull() & (s != ""))


def _bytes(item: Column) -> Column:
    return F.floor(F.length(item) / 2)


def low_r() -> Column:
    sizes = F.filter(F.transform(_signatures(), _bytes), lambda n: n.between(68, 73))
    return F.when(F.size(sizes) == 0, "na").when(F.array_max(sizes) <= 71, "low_r").otherwise("not_low_r")


#: Signature hash types, fixed values.
SIGHASH = {
    "01": "all",
    "02": "none",
    "03": "single",
    "81": "anyonecanpay_all",
    "82": "anyonecanpay_none",
    "83": "anyonecanpay_single",
}


def sighash() -> Column:
    def kind(s: Column) -> Column:
        n, last = _bytes(s), F.lower(F.right(s, F.lit(2)))
        named = F.coalesce(*(F.when(last == k, F.lit(v)) for k, v in SIGHASH.items()), F.concat(F.lit("sh_"), last))
        return F.when(n == 64, "taproot_default").when(n == 65, "taproot_explicit").when(n.between(68, 73), named)

    return _one_of(_known(F.transform(_signatures(), kind)), "na")


def fee_rate() -> Column:
    fee, weight = F.col("fee"), F.col("weight")
    rate = fee / (weight / 4)
    nearest = F.rint(rate)
    return (
        F.when(F.coalesce(fee, F.lit(0)) == 0, "na")
        .when(F.coalesce(weight, F.lit(0)) == 0, "na")
        .when((nearest >= 1) & (F.abs(rate - nearest) < 0.01), "round")
        .otherwise("precise")
    )


def input_script_type() -> Column:
    return _one_of(_known(input_types()), "na", "uniform_")


def op_return() -> Column:
    return F.when(_some(_vout(), lambda o: o["scriptpubkey_type"] == "op_return"), "has_op_return").otherwise("none")


#: Address encoding of each script type, fixed values.
ENCODING = {"p2pkh": "base58", "p2sh": "base58", "v0_p2wpkh": "bech32", "v0_p2wsh": "bech32", "v1_p2tr": "bech32m"}


def output_encoding() -> Column:
    named = lambda o: F.coalesce(*(F.when(o["scriptpubkey_type"] == k, F.lit(v)) for k, v in ENCODING.items()))
    return _one_of(_known(F.transform(_vout(), named)), "na")


def input_types_present() -> Column:
    kinds = F.array_sort(_known(input_types()))
    return F.when(F.size(kinds) == 0, "na").otherwise(F.array_join(kinds, "+"))


def nested_segwit() -> Column:
    test = lambda v: (v["prevout"]["scriptpubkey_type"] == "p2sh") & (F.size(v["witness"]) > 0)
    return F.when(_some(_vin(), test), "nested_segwit").otherwise("none")


def pubkey_compression() -> Column:
    def kind(v: Column) -> Column:
        key = F.try_element_at(v["witness"], F.lit(-1))
        n, head = _bytes(key), F.lower(F.left(key, F.lit(2)))
        fits = (v["prevout"]["scriptpubkey_type"] == "v0_p2wpkh") & (F.size(v["witness"]) >= 2)
        return F.when(fits & (n == 33) & head.isin("02", "03"), "compressed").when(fits & (n == 65) & (head == "04"), "uncompressed")

    return _one_of(_known(F.transform(_vin(), kind)), "na")


def multisig() -> Column:
    def test(v: Column) -> Column:
        kind = v["prevout"]["scriptpubkey_type"]
        script = F.lower(F.try_element_at(v["witness"], F.lit(-1)))
        return ((kind == "v0_p2wsh") & F.endswith(script, F.lit("ae"))) | (
            (kind == "p2sh") & F.endswith(F.lower(v["scriptsig"]), F.lit("ae"))
        )

    return F.when(_some(_vin(), test), "multisig").otherwise("none")


def change_position() -> Column:
    """Index of the less round of two outputs, else null."""
    a, b = (roundness(F.get(_vout(), F.lit(i))["value"]) for i in range(2))
    return F.when((F.size("vout") == 2) & (a != b), F.when(a < b, F.lit(0)).otherwise(F.lit(1)))


def change_index() -> Column:
    at = change_position()
    return F.when(at.isNull(), "na").when(at == 0, "first").otherwise("last")


def _change_type(other: bool = False) -> Column:
    at = change_position()
    return F.get(_vout(), 1 - at if other else at)["scriptpubkey_type"]


def change_type_match() -> Column:
    kind = _change_type()
    same = F.coalesce(F.exists(input_types(), lambda t: t.eqNullSafe(kind)), F.lit(False))
    return F.when(change_position().isNull(), "na").when(same, "match_input").otherwise("mismatch_input")


def change_matches_output() -> Column:
    same = _change_type().eqNullSafe(_change_type(True))
    return F.when(change_position().isNull(), "na").when(same, "match_output").otherwise("mismatch_output")


def change_address_reuse() -> Column:
    ins = _known(F.transform(_vin(), lambda v: v["prevout"]["scriptpubkey_address"]))
    outs = _known(F.transform(_vout(), lambda o: o["scriptpubkey_address"]))
    return F.when(F.coalesce(F.arrays_overlap(ins, outs), F.lit(False)), "reuse").otherwise("none")


def locktime_class(height: Column | None = None) -> Column:
    lock = F.col("locktime")
    height = F.col("height") if height is None else height
    back = height - lock
    return (
        F.when(lock == 0, "zero")
        .when(lock >= NO_TIMESTAMP_BELOW, "timestamp")
        .when(height.isNull(), "height")
        .when(back.between(-1, 1), "height_tip")
        .when(back.between(2, 100), "height_backdated")
        .otherwise("height_other")
    )


def feerate() -> Column:
    """Amount per virtual byte; null without fee or weight."""
    return F.when((F.col("fee") != 0) & (F.col("weight") != 0), F.col("fee") / (F.col("weight") / 4))


def locktime_vs_broadcast(bc: str = "_bc", height: str = "height") -> Column:
    """Lock time against the height at which the transaction was likely broadcast.

    The window is tight only if the fee rate beats the least rate of the block before (``prev_min``)."""
    lock, n = F.coalesce(F.col("locktime"), F.lit(0)), F.col(height)
    tight = F.coalesce(F.col(f"{bc}.prev_min") < feerate(), F.lit(False))
    return (
        F.when(F.col(bc).isNull() | n.isNull(), "na")
        .when(lock == 0, "no_locktime")
        .when(lock >= NO_TIMESTAMP_BELOW, "timestamp")
        .when(~tight, "na_loose")
        .when(lock > n + 1, "future")
        .when(lock >= n - 100, "matches")
        .otherwise("backdated")
    )


def address_type(address: Column) -> Column:
    return (
        F.when(F.coalesce(address, F.lit("")) == "", F.lit(None).cast("string"))
        .when(address.startswith("bc1p"), "v1_p2tr")
        .when(address.startswith("bc1q"), F.when(F.length(address) <= 42, "v0_p2wpkh").otherwise("v0_p2wsh"))
        .when(address.startswith("bc1"), "v0_unknown")
        .when(address.startswith("1"), "p2pkh")
        .when(address.startswith("3"), "p2sh")
        .otherwise("nonstandard")
    )


def output_type(output: Column) -> Column:
    """The given script type, or the one that the address shows."""
    given = F.when(output["scriptpubkey_type"] != "", output["scriptpubkey_type"])
    return F.coalesce(given, address_type(output["scriptpubkey_address"]))


#: The axes that are measured, by name.
AXES: dict[str, Callable[[], Column]] = {
    "nsequence": nsequence,
    "locktime": locktime_class,
    "input_order": input_order,
    "output_order": output_order,
    "change_spk": change_spk_type,
    "version": version,
    "io_shape": io_shape,
    "uih": uih,
    "fee_rate": fee_rate,
    "input_script_type": input_script_type,
    "output_encoding": output_encoding,
    "input_types_present": input_types_present,
    "change_index": change_index,
    "change_type_match": change_type_match,
    "change_matches_output": change_matches_output,
    "change_address_reuse": change_address_reuse,
    "low_r": low_r,
    "sighash": sighash,
    "op_return": op_return,
    "nested_segwit": nested_segwit,
    "pubkey_compression": pubkey_compression,
    "multisig": multisig,
}
