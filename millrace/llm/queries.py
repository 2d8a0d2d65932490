"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, jaccard, language, line_dedup, mixing, packing, pii, quality, toxicity

QUERIES = {
    "op1_quality": quality.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_toxicity": toxicity.op3,
    "op4_language": language.op4,
    "op5_pack": packing.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_jaccard_join": jaccard.op7,
    "op8_mix_sources": mixing.op8,
    "op9_pii": pii.op9,
    "op10_embedding_dedup": embedding_dedup.op10,
}
ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
}
