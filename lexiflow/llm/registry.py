"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from . import bpe, exact_dedup, filter_audit, jaccard_join, language_id, licenses, media, mixing, pii, token_counts, url_filter, variants, warc

QUERIES = {
    "op1_media_copies": media.op1_media_copies,
    "op2_language_id": language_id.op2_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_ngram_jaccard": jaccard_join.op7_ngram_jaccard,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_pii": pii.op9_pii,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_warc": warc.op13_warc,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_source_mix": mixing.SQL,
    "op10_url_filter": url_filter.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_warc": warc.SQL,
}
