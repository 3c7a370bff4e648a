"""The queries of this folder, each over its whole tables."""

from __future__ import annotations

from outline_jobs.llm import (
    decontamination, factorization, filter_audit, line_dedup, main_text, mixing, ngram_join, repair, sharding, url_lists, vector_codes, warc,
    weighted_sampling,
)

QUERIES = {
    "op1_weighted_sampling": weighted_sampling.query,
    "op2_pareto_mix": mixing.query,
    "op3_factorization": factorization.query,
    "op4_warc_dictionary": warc.query,
    "op5_temporal_lists": url_lists.query,
    "op6_repair_tokens": repair.query,
    "op7_ngram_banding": ngram_join.query,
    "op8_simhash_windows": decontamination.query,
    "op9_line_bitmaps": line_dedup.query,
    "op10_main_text": main_text.query,
    "op11_filter_audit": filter_audit.query,
    "op12_vector_codes": vector_codes.query,
    "op13_mixture_shards": sharding.query,
}
ORACLES = {
    "op2_pareto_mix": mixing.ORACLE,
    "op4_warc_dictionary": warc.ORACLE,
    "op5_temporal_lists": url_lists.ORACLE,
    "op7_ngram_banding": ngram_join.ORACLE,
    "op8_simhash_windows": decontamination.ORACLE,
    "op9_line_bitmaps": line_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_mixture_shards": sharding.ORACLE,
}
