"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from packetlog.llm import (conversations, decontaminate, langid, linededup, negatives, pii, quality, sentencepiece_fst, sharding, simhash,
                           tokencount, topk, toxicity)

QUERIES = {
    "op1_top_k": topk.op1_top_k,
    "op2_token_counts": tokencount.op2_token_counts,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sentencepiece": sentencepiece_fst.op4_sentencepiece,
    "op5_language_id": langid.op5_language_id,
    "op6_sharding": sharding.op6_sharding,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_pseudonyms": pii.op9_pseudonyms,
    "op10_simhash": simhash.op10_simhash,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_quality": quality.op12_quality,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": topk.OP1_SQL,
    "op7_line_dedup": linededup.OP7_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
}
