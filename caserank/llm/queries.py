"""The registered queries of this package and their DuckDB statements."""

from __future__ import annotations

from . import bpe, chat, filter_audit, impact_search, jaccard, langid, mil, packing, periodic_runs, quality_rules, suffix_dedup, suffix_tree, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_suffix_tree_scores": suffix_tree.query,
    "op3_weak_supervision_rules": quality_rules.query,
    "op4_attention_mil_quality": mil.query,
    "op5_chat_templates": chat.query,
    "op6_bloom_cascade_urls": url_filter.query,
    "op7_impact_ordered_topk": impact_search.query,
    "op8_pair_index_bpe": bpe.query,
    "op9_ngram_jaccard_join": jaccard.query,
    "op10_kneser_ney_langid": langid.query,
    "op11_suffix_array_dedup": suffix_dedup.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_filter_audit": filter_audit.query,
}

ORACLE = {
    "op6_bloom_cascade_urls": url_filter.ORACLE,
    "op7_impact_ordered_topk": impact_search.ORACLE,
    "op9_ngram_jaccard_join": jaccard.ORACLE,
    "op11_suffix_array_dedup": suffix_dedup.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_filter_audit": filter_audit.ORACLE,
}
