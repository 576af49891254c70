"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from logspar.llm import bpe, chat_format, embedding_dedup, exact_dedup, language_id, mixing, secrets, simhash, token_store, url_filter

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_token_store": token_store.op3_token_store,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_secrets": secrets.op5_secrets,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language_id.op8_language_id,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op2_url_filter": url_filter.OP2_SQL,
    "op5_secrets": secrets.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
