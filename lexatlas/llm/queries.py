"""Registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from lexatlas.llm import decontaminate, ngram_join, packing, pii, quality_rules, quotes, secrets, suffix_dedup, topk, warc

QUERIES = {
    "op1_signature_tree_jaccard_join": ngram_join.op1,
    "op2_quotation_linking": quotes.op2,
    "op3_block_max_wand_decontamination": decontaminate.op3,
    "op4_norm_sorted_top_k": topk.op4,
    "op5_deep_shallow_suffix_dedup": suffix_dedup.op5,
    "op6_cost_balanced_packing": packing.op6,
    "op7_secret_forest": secrets.op7,
    "op8_semi_markov_pii": pii.op8,
    "op9_warc_gzip_normaliser": warc.op9,
    "op10_quality_rule_ensemble": quality_rules.op10,
}
ORACLES: dict[str, str] = {
    "op1_signature_tree_jaccard_join": ngram_join.OP1_SQL,
    "op5_deep_shallow_suffix_dedup": suffix_dedup.OP5_SQL,
    "op4_norm_sorted_top_k": topk.OP4_SQL,
    "op9_warc_gzip_normaliser": warc.OP9_SQL,
}
