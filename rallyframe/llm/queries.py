"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from . import decontam, langid, linededup, mixing, neardup, pages, quality, rules, secrets, tokens

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_quality_score": quality.op3_quality_score,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_language_id": langid.op7_language_id,
    "op8_main_text": pages.op8_main_text,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_near_dedup": neardup.op10_near_dedup,
}

ORACLE_SQL = {
    "op2_mix_sources": mixing.ORACLE_OP2,
    "op5_quality_rules": rules.ORACLE_OP5,
    "op6_decontaminate": decontam.ORACLE_OP6,
    "op9_line_dedup": linededup.ORACLE_OP9,
    "op10_near_dedup": neardup.ORACLE_OP10,
}
