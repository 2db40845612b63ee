"""The text queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from sparkloom.llm import bpe, chat_format, exact_dedup, packing, quality_gam, quality_rules, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_quality_classifier": quality_gam.op3_quality_classifier,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_packing": packing.op9_packing,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
}
