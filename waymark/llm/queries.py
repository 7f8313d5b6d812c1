"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from waymark.llm import decontaminate, huffman, language_id, licenses, packing, quality_model, quality_rules, secrets, simhash, substring_dedup

QUERIES = {
    "op1_huffman": huffman.op1_huffman,
    "op2_packing": packing.op2_packing,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_simhash": simhash.op4_simhash,
    "op5_licenses": licenses.op5_licenses,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_secrets": secrets.op7_secrets,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_language_id": language_id.op10_language_id,
}

ORACLES = {
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
}
