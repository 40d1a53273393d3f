"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from loomline.llm import op01_toxicity, op02_url_filters, op03_exact_dedup, op04_mixing, op05_language_id, op06_packing, op07_line_dedup, op08_quality_rules, op09_simhash, op10_sharding


def queries() -> dict:
    return {
        "op1_toxicity": op01_toxicity.op1_toxicity,
        "op2_url_filters": op02_url_filters.op2_url_filters,
        "op3_exact_dedup": op03_exact_dedup.op3_exact_dedup,
        "op4_mixing": op04_mixing.op4_mixing,
        "op5_language_id": op05_language_id.op5_language_id,
        "op6_packing": op06_packing.op6_packing,
        "op7_line_dedup": op07_line_dedup.op7_line_dedup,
        "op8_quality_rules": op08_quality_rules.op8_quality_rules,
        "op9_simhash": op09_simhash.op9_simhash,
        "op10_sharding": op10_sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": op02_url_filters.SQL,
        "op3_exact_dedup": op03_exact_dedup.SQL,
        "op8_quality_rules": op08_quality_rules.SQL,
    }
