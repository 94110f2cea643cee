"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, collocations, decontamination, embedding_dedup, html_extraction, language_id, ngram_join, pipeline, quality_mil, secret_scan, spelling, substring_dedup, token_counts, warc

QUERIES = {
    "op1_quality_mil": quality_mil.query,
    "op2_embedding_dedup": embedding_dedup.query,
    "op3_warc_derivatives": warc.query,
    "op4_secret_scan": secret_scan.query,
    "op5_ngram_jaccard_join": ngram_join.query,
    "op6_language_id": language_id.query,
    "op8_byte_bpe": byte_bpe.query,
    "op7_substring_dedup": substring_dedup.query,
    "op9_html_extraction": html_extraction.query,
    "op10_decontamination": decontamination.query,
    "op11_spelling_variants": spelling.query,
    "op12_token_counts": token_counts.query,
    "op13_collocations": collocations.query,
    "pipeline": pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op5_ngram_jaccard_join": ngram_join.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op10_decontamination": decontamination.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op13_collocations": collocations.SQL,
}
