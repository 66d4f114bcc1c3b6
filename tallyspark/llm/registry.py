"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import chatformat, decontam, htmltext, mixing, neardup, quality, ranked, rlz, secretscan, spelling, suffixes, surrogates, toxicity

QUERIES = {
    "op1_html_text": htmltext.op1_html_text,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_mix": mixing.op4_mix,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_surrogates": surrogates.op7_surrogates,
    "op8_substring_dedup": rlz.op8_substring_dedup,
    "op9_secrets": secretscan.op9_secrets,
    "op10_neardup": neardup.op10_neardup,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_chat_format": chatformat.op12_chat_format,
    "op13_spelling": spelling.op13_spelling,
}
ORACLES = {
    "op2_suffix_dedup": suffixes.ORACLE,
    "op3_decontaminate": decontam.ORACLE,
    "op4_mix": mixing.ORACLE,
    "op5_quality": quality.ORACLE,
    "op8_substring_dedup": rlz.ORACLE,
    "op10_neardup": neardup.ORACLE,
    "op11_ranked_search": ranked.ORACLE,
    "op12_chat_format": chatformat.ORACLE,
    "op13_spelling": spelling.ORACLE,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
