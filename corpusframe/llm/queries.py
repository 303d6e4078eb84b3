"""Queries opN_<name> over the shared tables, and the SQL that DuckDB can check them with."""

from corpusframe.llm import decontamination, fingerprints, jaccard_join, license_scans, line_dedup, lm_scoring, mixing, periodic_runs, sharding, suffix_dedup, toxicity, url_filters, whitening

QUERIES = {
    "op1_license_scans": license_scans.op1_license_scans,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_sharding": sharding.op3_sharding,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_mixing": mixing.op8_mixing,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {
    "op1_license_scans": license_scans.oracle(),
    "op5_line_dedup": line_dedup.ORACLE,
    "op10_url_filters": url_filters.oracle(),
}
