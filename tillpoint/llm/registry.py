"""The operators' queries, each over its whole table with production
parameters, and their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from tillpoint.llm import binary_output, collocations, decontam, jaccard_join, langid, mixing, prefix_trie, quality, simhash, substring, suffix_tree, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_language_id": langid.op1,
        "op2_quality_rules": quality.op2,
        "op3_source_mix": mixing.op3,
        "op4_simhash_near_dedup": simhash.op4,
        "op5_toxicity": toxicity.op5,
        "op6_benchmark_decontamination": decontam.op6,
        "op7_token_records": binary_output.op7,
        "op8_lm_scoring": suffix_tree.op8,
        "op9_substring_dedup": substring.op9,
        "op10_token_counts": token_counts.op10,
        "op11_prefix_trie": prefix_trie.op11,
        "op12_phrase_collocations": collocations.op12,
        "op13_ngram_jaccard_join": jaccard_join.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mix": mixing.OP3_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op12_phrase_collocations": collocations.OP12_SQL,
        "op13_ngram_jaccard_join": jaccard_join.OP13_SQL,
    }
