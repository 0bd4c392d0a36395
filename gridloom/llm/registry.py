"""The queries of this subpackage and their SQL, added to the entry point where the subpackage is there."""

from __future__ import annotations

from . import chains, chat, decontam, lines, neardup, pieces, ppm, quality, sharding, tokens

QUERIES = {
    "op1_collinear_chains": chains.query,
    "op2_host_quality": quality.query,
    "op3_winnowing": decontam.query,
    "op4_sentencepiece_transducer": pieces.query,
    "op5_hash_tree_shards": sharding.query,
    "op6_chat_format": chat.query,
    "op7_ppm_scores": ppm.query,
    "op8_line_deletion_join": lines.query,
    "op9_prefix_token_counts": tokens.query,
    "op10_circulant_minhash": neardup.query,
}

SQL = {
    "op2_host_quality": quality.SQL,
    "op3_winnowing": decontam.SQL,
    "op6_chat_format": chat.SQL,
    "op8_line_deletion_join": lines.SQL,
}
