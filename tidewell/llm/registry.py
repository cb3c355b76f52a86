"""The queries of this package by name, and their SQL."""

from __future__ import annotations

from tidewell.llm import bpe, language_id, multiset_hash, packing, pseudonyms, simhash, substring_dedup, token_shards, toxicity, transport_stream

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_fingerprints": multiset_hash.op2_fingerprints,
    "op3_packing": packing.op3_packing,
    "op4_language_id": language_id.op4_language_id,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pseudonyms": pseudonyms.op6_pseudonyms,
    "op7_media": transport_stream.op7_media,
    "op8_token_shards": token_shards.op8_token_shards,
    "op9_simhash": simhash.op9_simhash,
    "op10_bpe": bpe.op10_bpe,
}

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": substring_dedup.ORACLE_SQL}
