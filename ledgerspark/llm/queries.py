"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import align, bpe, decontaminate, exact_dedup, extract, pieces, quality, resample, sharding, simhash, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_html_extraction": extract.op4_html_extraction,
    "op5_quality": quality.op5_quality,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_url_filters": url_filter.op10_url_filters,
    "op11_token_counts": pieces.op11_token_counts,
    "op12_resample": resample.op12_resample,
    "op13_alignment": align.op13_alignment,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op6_decontamination": decontaminate.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op12_resample": resample.OP12_SQL,
}
