"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from seriesmith.llm import conversations, conversations_sql, exact_dedup, hard_negatives, html_extraction, media, mixing, sentencepiece_codec, simhash, substring_dedup, suffix_dedup, token_ids, toxicity, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_warc": warc.op4_warc,
    "op5_simhash": simhash.op5_simhash,
    "op6_token_ids": token_ids.op6_token_ids,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_media": media.op8_media,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_mixing": mixing.op10_mixing,
    "op11_conversations": conversations.op11_conversations,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_warc": warc.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_conversations": conversations_sql.ORACLE,
    "op12_suffix_dedup": suffix_dedup.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
