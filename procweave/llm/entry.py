"""The corpus operators' queries and their DuckDB twins."""

from __future__ import annotations

from procweave.llm import (
    arc_convert,
    chat_format,
    decontam,
    hard_negatives,
    language_id,
    license_scan,
    merkle,
    minhash,
    mixing,
    quality,
    token_count,
    url_filter,
    vp_search,
)

QUERIES = {
    "op1_arc_to_warc": arc_convert.op1_arc_to_warc,
    "op2_mixing": mixing.op2_mixing,
    "op3_vp_tree_search": vp_search.op3_vp_tree_search,
    "op4_chat_formatting": chat_format.op4_chat_formatting,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_license_scans": license_scan.op6_license_scans,
    "op7_minhash_dedup": minhash.op7_minhash_dedup,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_token_counts": token_count.op9_token_counts,
    "op10_url_filters": url_filter.op10_url_filters,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_language_id": language_id.op13_language_id,
}

ORACLES = {
    "op1_arc_to_warc": arc_convert.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op3_vp_tree_search": vp_search.ORACLE,
    "op4_chat_formatting": chat_format.ORACLE,
    "op7_minhash_dedup": minhash.ORACLE,
    "op10_url_filters": url_filter.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
