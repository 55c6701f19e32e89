"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from isobar.llm import bt_quality, crf_language, decontaminate, exact_dedup, fm_toxicity, kd_sharding, line_dedup, packing, pii, setsketch

QUERIES = {
    "op1_language_id": crf_language.op1_language_id,
    "op2_kd_sharding": kd_sharding.op2_kd_sharding,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": fm_toxicity.op4_toxicity,
    "op5_near_dedup": setsketch.op5_near_dedup,
    "op6_quality": bt_quality.op6_quality,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_pseudonyms": pii.op9_pseudonyms,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLE_SQL = {
    "op5_near_dedup": setsketch.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
