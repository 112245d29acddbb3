"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann_search, line_dedup, lm_scoring, minhash_dedup, mixing, packing, quality_rules, secret_scan, spelling, token_alignment, token_counts, token_store, warc_archive

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_warc_archive": warc_archive.op2_warc_archive,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_ann_search": ann_search.op5_ann_search,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_token_store": token_store.op7_token_store,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}

ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op2_warc_archive": warc_archive.ORACLE_SQL,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op8_secret_scan": secret_scan.ORACLE_SQL,
    "op13_line_dedup": line_dedup.ORACLE_SQL,
}
