"""Queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from . import embedding_dedup, line_dedup, minhash, mixing, packing, quality, secrets, substring_dedup, token_files, url_filter


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1,
        "op2_embedding_dedup": embedding_dedup.op2,
        "op3_minhash": minhash.op3,
        "op4_secret_scan": secrets.op4,
        "op5_mix_sources": mixing.op5,
        "op6_token_files": token_files.op6,
        "op7_substring_dedup": substring_dedup.op7,
        "op8_url_filter": url_filter.op8,
        "op9_quality_rules": quality.op9,
        "op10_pack_sequences": packing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op2_embedding_dedup": embedding_dedup.SQL,
        "op3_minhash": minhash.SQL,
        "op7_substring_dedup": substring_dedup.SQL,
        "op8_url_filter": url_filter.SQL,
        "op9_quality_rules": quality.SQL,
    }
