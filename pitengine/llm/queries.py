"""The queries of this subpackage and their DuckDB SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from pitengine.llm import (
    bpe,
    curriculum_mix,
    exact_dedup,
    hard_negatives,
    language_id,
    license_scan,
    periodic_runs,
    personal_data,
    quality_rules,
    simhash_dedup,
    token_files,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_toxicity": toxicity.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_bpe": bpe.query,
    "op5_license_scan": license_scan.query,
    "op6_curriculum_mix": curriculum_mix.query,
    "op7_url_filter": url_filter.query,
    "op8_simhash_dedup": simhash_dedup.query,
    "op9_quality_rules": quality_rules.query,
    "op10_language_id": language_id.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_personal_data": personal_data.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op5_license_scan": license_scan.ORACLE,
    "op6_curriculum_mix": curriculum_mix.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
}
