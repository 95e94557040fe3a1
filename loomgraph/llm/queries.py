"""The registered queries of the training-data operators."""

from . import bpe, chunking, contentsort, decontaminate, divergence, fingerprint, hilbert, jaccard, langid, pii, toxicity, vectorcodes

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.query,
    "op2_personal_data": pii.query,
    "op3_token_counts": bpe.count_query,
    "op4_substring_dedup": chunking.query,
    "op5_ngram_jaccard_join": jaccard.query,
    "op6_language_id": langid.query,
    "op7_document_fingerprints": fingerprint.query,
    "op8_toxicity": toxicity.query,
    "op9_hilbert_sharding": hilbert.query,
    "op10_bpe_codec": bpe.encode_query,
    "op11_source_divergence": divergence.query,
    "op12_content_sort_dedup": contentsort.query,
    "op13_vector_codes": vectorcodes.query,
}
ORACLES = {
    "op1_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op12_content_sort_dedup": contentsort.ORACLE_SQL,
    "op13_vector_codes": vectorcodes.ORACLE_SQL,
}
