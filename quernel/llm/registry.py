"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from quernel.llm import ann, decontaminate, language, lm, mixing, simhash, substring, suffix, token_counts, url_filter

QUERIES = {
    "op1_lm_scores": lm.op1_lm_scores,
    "op2_nearest": ann.op2_nearest,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_simhash": simhash.op5_simhash,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_substring": substring.op7_substring,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_language_id": language.op9_language_id,
    "op10_suffix": suffix.op10_suffix,
}
ORACLE_SQL = {"op1_lm_scores": lm.ORACLE_SQL, "op3_mixing": mixing.ORACLE_SQL, "op8_url_filter": url_filter.ORACLE_SQL}
