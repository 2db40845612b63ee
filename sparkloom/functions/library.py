"""Measured evidence bits per axis value: the seed table of the scorers."""

from __future__ import annotations

# Bits of evidence per agreeing value; a value of 0 bits abstains.
BITS: dict[str, dict[str, float]] = {
    "nsequence": {
        "max_ffffffff": 0.82, "rbf_fffffffd": 2.35, "final_fffffffe": 2.42, "mixed_other": 4.38,
        "seq_0x01_other": 8.89, "cake_group_c": 13.88,
    },
    "locktime": {"zero": 0.43, "height_backdated": 2.94, "height_tip": 3.01, "height_other": 7.65, "timestamp": 10.85},
    "input_order": {"single": 0.53, "shuffle": 2.46, "bip69": 3.00, "small_n": 0.00},
    "output_order": {"sorted_value": 1.43, "unsorted": 1.61, "single": 1.72, "small_n": 0.00},
    "change_spk": {
        "uniform_p2pkh": 0.92, "mixed": 1.77, "uniform_v0_p2wpkh": 3.42, "uniform_p2sh": 3.96,
        "uniform_v1_p2tr": 5.92, "uniform_v0_p2wsh": 8.26,
    },
    "version": {"v1": 0.67, "v2": 1.42, "v3": 11.60},
    "io_shape": {"1in-2out": 1.38, "1in-1out": 2.17, "2in-2out": 3.95, "3in-2out": 4.31},
    "uih": {"none": 0.12, "uih1": 3.59},
    "fee_rate": {"precise": 0.28, "round": 2.53, "na": 7.99},
    "input_script_type": {
        "uniform_p2pkh": 0.87, "uniform_v0_p2wpkh": 2.18, "uniform_p2sh": 2.59, "uniform_v1_p2tr": 4.68,
        "mixed": 6.00, "uniform_v0_p2wsh": 6.71,
    },
    "output_encoding": {"base58": 0.38, "bech32": 2.93, "mixed": 3.71, "bech32m": 5.50, "na": 9.15},
    "input_types_present": {
        "p2pkh": 0.87, "v0_p2wpkh": 2.18, "p2sh": 2.59, "v1_p2tr": 4.68, "v0_p2wsh": 6.71, "p2pkh+p2sh": 7.58,
        "p2pkh+v0_p2wpkh": 8.20,
    },
    "change_index": {"na": 0.48, "last": 2.59, "first": 3.10},
    "change_type_match": {"na": 0.48, "match_input": 1.92, "mismatch_input": 5.72},
    "change_matches_output": {"na": 0.48, "match_output": 2.35, "mismatch_output": 3.52},
    "change_address_reuse": {"none": 0.37, "reuse": 2.14},
    "low_r": {"na": 0.64, "low_r": 2.30, "not_low_r": 2.68},
    "sighash": {"na": 0.81, "all": 1.49, "taproot_default": 3.96, "mixed": 7.38, "taproot_explicit": 8.31},
    "op_return": {"none": 0.09, "has_op_return": 4.00},
    "nested_segwit": {"none": 0.17, "nested_segwit": 3.15},
    "pubkey_compression": {"na": 0.46, "compressed": 1.86},
    "multisig": {"none": 0.09, "multisig": 4.02},
    "locktime_vs_broadcast": {"no_locktime": 0.22, "matches": 2.85, "na_loose": 0.00, "backdated": 9.48},
}


def shares(axis: str) -> dict[str, float]:
    """Probability per value; values of no bits are left out."""
    return {v: 2.0**-b for v, b in BITS.get(axis, {}).items() if b > 0}


def bits(axis: str, value: str) -> float | None:
    return BITS.get(axis, {}).get(value)
