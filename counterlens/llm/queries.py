"""Queries over whole tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from counterlens.llm import bpe_prefix, divergence, hard_negatives, hnsw, language_id, line_dedup, mixing, near_dedup, page_text, sharding, substring_dedup, token_shards, transport_stream

QUERIES = {
    "op1_token_shards": token_shards.query,
    "op8_transport_stream": transport_stream.query,
    "op9_language_id": language_id.query,
    "op10_substring_dedup": substring_dedup.query,
    "op6_hnsw": hnsw.query,
    "op7_bpe_prefix": bpe_prefix.query,
    "op2_mixing": mixing.query,
    "op3_sharding": sharding.query,
    "op4_page_text": page_text.query,
    "op5_minhash_near_dedup": near_dedup.query,
    "op11_divergence_audit": divergence.query,
    "op12_line_dedup": line_dedup.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE_SQL,
    "op10_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_divergence_audit": divergence.ORACLE_SQL,
    "op12_line_dedup": line_dedup.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
