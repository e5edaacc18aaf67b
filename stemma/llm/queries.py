"""The queries of the ten operators and, where SQL can say it, the same as DuckDB SQL."""

from __future__ import annotations

from stemma.llm import embedding_dedup, html_extraction, language_id, mixing, packing, quality_classifier, quality_rules, simhash, tokens, url_filters

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_language_id": language_id.op2_language_id,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_mixing": mixing.op7_mixing,
    "op8_html_extraction": html_extraction.op8_html_extraction,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_token_output": tokens.op10_token_output,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op3_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op5_url_filters": url_filters.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
}
