"""The registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from sightline.llm import decontaminate, language_id, license_scan, minhash_dedup, packing, pq_dedup, prefix_tokens, substring_dedup, url_filter, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_minhash_dedup": minhash_dedup.op4_minhash_dedup,
    "op5_warc_round_trip": warc.op5_warc_round_trip,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_pq_dedup": pq_dedup.op8_pq_dedup,
    "op9_prefix_token_counts": prefix_tokens.op9_prefix_token_counts,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {
    "op2_license_scan": license_scan.ORACLE,
    "op4_minhash_dedup": minhash_dedup.ORACLE,
    "op5_warc_round_trip": warc.ORACLE,
    "op8_pq_dedup": pq_dedup.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
}
