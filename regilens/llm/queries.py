"""The corpus operators' queries, one per operator and the pipeline, with DuckDB
SQL where SQL can express the result."""

from __future__ import annotations

import corpus_pipeline

from . import curve_search, decontaminate, hard_negatives, langid, license_scan, mixing, near_dedup, ngram_join, passages, quality, spelling, suffix_lm, url_trust

QUERIES = {
    "op1_host_trust": url_trust.op1_host_trust,
    "op2_license_diagonals": license_scan.op2_license_diagonals,
    "op3_lsh_forest_join": ngram_join.op3_lsh_forest_join,
    "op4_word_backoff": langid.op4_word_backoff,
    "op5_chained_passages": passages.op5_chained_passages,
    "op6_suffix_tree": suffix_lm.op6_suffix_tree,
    "op7_hilbert_search": curve_search.op7_hilbert_search,
    "op8_bradley_terry": quality.op8_bradley_terry,
    "op9_positional_index": decontaminate.op9_positional_index,
    "op10_curriculum_mix": mixing.op10_curriculum_mix,
    "op11_rotated_codes": hard_negatives.op11_rotated_codes,
    "op12_bayesian_dedup": near_dedup.op12_bayesian_dedup,
    "op13_spelling_chunks": spelling.op13_spelling_chunks,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_host_trust": url_trust.ORACLE,
    "op2_license_diagonals": license_scan.ORACLE,
    "op9_positional_index": decontaminate.ORACLE,
    "op10_curriculum_mix": mixing.ORACLE,
    "op11_rotated_codes": hard_negatives.ORACLE,
    "op12_bayesian_dedup": near_dedup.ORACLE,
}
