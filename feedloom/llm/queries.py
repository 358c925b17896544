"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from feedloom.llm.decontam import OP1_SQL, op1_benchmark_decontamination
from feedloom.llm.lexical import OP13_SQL, op13_ranked_lexical_search
from feedloom.llm.licenses import op7_license_scans
from feedloom.llm.multiindex import OP6_SQL, op6_embedding_near_dedup
from feedloom.llm.ngramratio import OP11_SQL, op11_quality_rules
from feedloom.llm.packing import op10_best_fit_packing
from feedloom.llm.resampling import OP12_SQL, op12_importance_resampling
from feedloom.llm.simhash import op5_simhash_near_dedup
from feedloom.llm.substring import op3_substring_dedup
from feedloom.llm.tokencount import op8_token_counts
from feedloom.llm.toxicity import op2_toxicity
from feedloom.llm.urlmodel import op4_url_filters
from feedloom.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_license_scans": op7_license_scans,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_quality_rules": op11_quality_rules,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

ORACLE: dict[str, str] = {
    "op1_benchmark_decontamination": OP1_SQL,
    "op6_embedding_near_dedup": OP6_SQL,
    "op9_warc": OP9_SQL,
    "op11_quality_rules": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_ranked_lexical_search": OP13_SQL,
}
