"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, language, media, mixing, ngram_join, pieces, suffix_dedup, toxicity, warc, wavelet

QUERIES = {
    "op1_wavelet_shards": wavelet.query,
    "op2_sentencepiece_scan": pieces.query,
    "op3_embedding_near_dedup": embedding_dedup.query,
    "op4_mixing_ipf": mixing.query,
    "op5_warc_source": warc.query,
    "op6_toxicity_chain": toxicity.query,
    "op7_language_id": language.query,
    "op8_ngram_jaccard_join": ngram_join.query,
    "op9_media_chunks": media.query,
    "op10_suffix_array_dedup": suffix_dedup.query,
}
ORACLE_SQL = {
    "op3_embedding_near_dedup": embedding_dedup.SQL,
    "op4_mixing_ipf": mixing.SQL,
    "op5_warc_source": warc.SQL,
    "op8_ngram_jaccard_join": ngram_join.SQL,
}
