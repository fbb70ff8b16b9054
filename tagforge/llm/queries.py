"""The queries of this folder and their SQL."""

from __future__ import annotations

from . import bpe_words, chain_dedup, exact_dedup, jaccard_join, lang_id, mixing, suffix_dedup, token_stream, topk, warc

QUERIES = {
    "op1_ngram_jaccard": jaccard_join.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_mixing": mixing.op3,
    "op4_bpe_words": bpe_words.op4,
    "op5_suffix_dedup": suffix_dedup.op5,
    "op6_warc_revisit": warc.op6,
    "op7_language_id": lang_id.op7,
    "op8_chain_dedup": chain_dedup.op8,
    "op9_token_stream": token_stream.op9,
    "op10_top_k": topk.op10,
}

SQL = {
    "op1_ngram_jaccard": jaccard_join.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op6_warc_revisit": warc.OP6_SQL,
    "op10_top_k": topk.OP10_SQL,
}
