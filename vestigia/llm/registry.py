"""Queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from vestigia.llm import decontaminate, fill_middle, licenses, near_dups, packing, personal_data, pieces, quality_rules, repair, token_counts, token_files, url_filter, warc

QUERIES = {
    "op1_warc_revisits": warc.op1_warc_revisits,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_license_sentences": licenses.op3_license_sentences,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_url_language_model": url_filter.op5_url_language_model,
    "op6_pii_weak_supervision": personal_data.op6_pii_weak_supervision,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_simple8b_files": token_files.op8_simple8b_files,
    "op9_minhash_near_dedup": near_dups.op9_minhash_near_dedup,
    "op10_sentencepiece_viterbi": pieces.op10_sentencepiece_viterbi,
    "op11_vector_packing": packing.op11_vector_packing,
    "op12_auction_repair": repair.op12_auction_repair,
    "op13_fill_middle": fill_middle.op13_fill_middle,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_warc_revisits": warc.ORACLE,
    "op3_license_sentences": licenses.ORACLE,
    "op5_url_language_model": url_filter.ORACLE,
    "op7_benchmark_decontamination": decontaminate.ORACLE,
    "op9_minhash_near_dedup": near_dups.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
