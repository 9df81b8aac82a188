"""The queries of this subpackage, by name, and the SQL that must agree with them."""

from __future__ import annotations

from . import chat_format, decontamination, exact_dedup, html_text, jaccard_join, language_id, mixing, pii, token_files, toxicity

QUERIES = {
    "op1_pii": pii.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_toxicity": toxicity.query,
    "op4_source_mixing": mixing.query,
    "op5_language_id": language_id.query,
    "op6_token_files": token_files.query,
    "op7_decontamination": decontamination.query,
    "op8_chat_format": chat_format.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_html_text": html_text.query,
}

#: Only where SQL can express the operator; the others are tested against brute force.
ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_source_mixing": mixing.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
}
