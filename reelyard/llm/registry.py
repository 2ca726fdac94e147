"""Queries of this subpackage, and the SQL of those that SQL expresses on whole tables."""

from reelyard.llm import bit_slices, byte_bpe, decontaminate, filter_audit, mixing, quality, repeats, resampling, set_join, sharding, token_counts, toxicity, wrappers

QUERIES = {
    "op1_toxicity_severity": toxicity.op1_query,
    "op2_run_length_repeats": repeats.op2_query,
    "op3_source_mixing": mixing.op3_query,
    "op4_bit_sliced_search": bit_slices.op4_query,
    "op5_page_wrappers": wrappers.op5_query,
    "op6_token_counts": token_counts.op6_query,
    "op7_benchmark_leaks": decontaminate.op7_query,
    "op8_hilbert_sharding": sharding.op8_query,
    "op9_set_relations_join": set_join.op9_query,
    "op10_importance_resampling": quality.op10_query,
    "op11_target_resampling": resampling.op11_query,
    "op12_merge_replay_bpe": byte_bpe.op12_query,
    "op13_filter_audit": filter_audit.op13_query,
}
ORACLES = {"op4_bit_sliced_search": bit_slices.OP4_SQL, "op11_target_resampling": resampling.OP11_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
