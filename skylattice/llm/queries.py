"""Queries of the training-data operators, by name, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from . import alignment, chat, extract, fingerprint, jaccard, minhash, packing, pieces, pitman, quality, secrets, warc, whitening

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_not_modified_revisits": warc.op2_not_modified_revisits,
    "op3_document_fingerprints": fingerprint.op3_document_fingerprints,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_html_extraction": extract.op5_html_extraction,
    "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
    "op7_pitman_yor_scores": pitman.op7_pitman_yor_scores,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_minhash_near_dedup": minhash.op11_minhash_near_dedup,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}
ORACLES = {"op2_not_modified_revisits": warc.ORACLE, "op6_ngram_jaccard_join": jaccard.ORACLE, "op8_secret_scans": secrets.ORACLE, "op10_chat_formatting": chat.ORACLE, "op11_minhash_near_dedup": minhash.ORACLE}
