"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import hard_negatives, language_id, line_dedup, media, merkle, minhash_dedup, mixing, packing, quality, sharding, suffix_dedup, token_output, vector_dedup


def queries() -> dict:
    return {
        "op1_vector_near_dedup": vector_dedup.op1_vector_near_dedup,
        "op2_token_orc": token_output.op2_token_orc,
        "op3_quality": quality.op3_quality,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_repeated_bytes": suffix_dedup.op5_repeated_bytes,
        "op6_webp_media": media.op6_webp_media,
        "op7_minhash_near_dedup": minhash_dedup.op7_minhash_near_dedup,
        "op8_source_mixing": mixing.op8_source_mixing,
        "op9_packing": packing.op9_packing,
        "op10_language_id": language_id.op10_language_id,
        "op11_sharding": sharding.op11_sharding,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_vector_near_dedup": vector_dedup.ORACLE_SQL,
        "op4_line_dedup": line_dedup.ORACLE_SQL,
        "op5_repeated_bytes": suffix_dedup.ORACLE_SQL,
        "op7_minhash_near_dedup": minhash_dedup.ORACLE_SQL,
        "op8_source_mixing": mixing.ORACLE_SQL,
        "op11_sharding": sharding.ORACLE_SQL,
        "op12_merkle_manifest": merkle.ORACLE_SQL,
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
