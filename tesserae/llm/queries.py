"""The queries of this subpackage, and the SQL for those that SQL can state."""

from __future__ import annotations

from tesserae.llm import (
    bpe_codec,
    chat_format,
    embedding_dedup,
    mixing,
    quality_rules,
    secret_scan,
    simhash_dedup,
    substring_dedup,
    token_binary,
    token_counts,
)


def queries():
    return {
        "op1_chat_format": chat_format.query,
        "op2_secret_scan": secret_scan.query,
        "op3_substring_dedup": substring_dedup.query,
        "op4_token_counts": token_counts.query,
        "op5_mixing": mixing.query,
        "op6_bpe_encode_decode": bpe_codec.query,
        "op7_simhash_dedup": simhash_dedup.query,
        "op8_embedding_dedup": embedding_dedup.query,
        "op9_quality_rules": quality_rules.query,
        "op10_token_binary": token_binary.query,
    }


def oracle_sql():
    return {"op1_chat_format": chat_format.SQL, "op5_mixing": mixing.SQL, "op9_quality_rules": quality_rules.SQL}
