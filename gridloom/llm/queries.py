"""The queries of this subpackage."""

from __future__ import annotations

from gridloom.llm import chat_format, ctw, divergence, exact_dedup, filter_audit, packing, rlz_dedup, sentencepiece_lattice, simhash, simhash_dedup, suffix_dedup, token_counts, toxicity


def queries() -> dict:
    found = (
        suffix_dedup.op1_suffix_array_dedup,
        token_counts.op2_token_counts,
        exact_dedup.op3_exact_dedup,
        toxicity.op4_toxicity,
        ctw.op5_context_tree_scores,
        sentencepiece_lattice.op6_sentencepiece_lattice,
        simhash.op7_simhash_fingerprints,
        packing.op8_best_fit_packing,
        simhash_dedup.op9_simhash_near_dedup,
        rlz_dedup.op10_rlz_substring_dedup,
        filter_audit.op11_filter_interaction_audit,
        chat_format.op12_chat_formatting,
        divergence.op13_source_divergence_audit,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": suffix_dedup.ORACLE,
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op10_rlz_substring_dedup": rlz_dedup.ORACLE,
        "op11_filter_interaction_audit": filter_audit.ORACLE,
        "op12_chat_formatting": chat_format.ORACLE,
        "op13_source_divergence_audit": divergence.ORACLE,
    }
