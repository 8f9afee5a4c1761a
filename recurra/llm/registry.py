"""The operators' queries and the SQL that must give the same rows."""

from __future__ import annotations

from . import bpe, decontamination, embedding_dedup, line_dedup, near_dedup, pii, sharding, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_suffix_array_dedup": substring_dedup.op1_suffix_array_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_bpe": bpe.op3_bpe,
    "op4_embedding_near_dedup": embedding_dedup.op4_embedding_near_dedup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_kd_sharding": sharding.op6_kd_sharding,
    "op7_pii": pii.op7_pii,
    "pii_base": pii.pii_base,
    "op8_toxicity": toxicity.op8_toxicity,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
}
SQL = {
    "op1_suffix_array_dedup": substring_dedup.SQL,
    "pii_base": pii.SQL_BASE,
    "op4_embedding_near_dedup": embedding_dedup.SQL,
    "op10_minhash_near_dedup": near_dedup.SQL,
    "op2_decontamination": decontamination.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
