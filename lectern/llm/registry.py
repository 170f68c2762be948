"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import decontaminate, language_id, mixing, mixing_lm, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        quality_rules.op1_mcd_quality,
        mixing_lm.op2_context_mixing,
        decontaminate.op3_pigeonhole_decontaminate,
        suffix_dedup.op4_suffix_dedup,
        language_id.op5_marginal_language_id,
        simhash.op6_simhash_pivots,
        quality_classifier.op7_attention_quality,
        mixing.op8_poisson_mix,
        token_counts.op9_token_attribution,
        toxicity.op10_blockmax_toxicity,
    )
}
ORACLES = {"op4_suffix_dedup": suffix_dedup.ORACLE, "op8_poisson_mix": mixing.ORACLE}
