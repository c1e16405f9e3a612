"""The registered queries of this package and their SQL."""

from __future__ import annotations

from filinglens.llm import (
    circulant_minhash, conversation_repair, decontamination, html_extraction, jaccard_join, merkle_manifest, mixing, quality_classifier, quality_rules,
    secret_scan, sharding, substring_dedup, token_counts,
)

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_sharding": sharding.op4_sharding,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_minhash_dedup": circulant_minhash.op13_minhash_dedup,
}
ORACLES = {
    "op3_jaccard_join": jaccard_join.OP3_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op12_merkle_manifest": merkle_manifest.OP12_SQL,
    "op13_minhash_dedup": circulant_minhash.OP13_SQL,
}
