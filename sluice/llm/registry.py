"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, langid, near_dup, packing, prefix_trie, quality, search, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_quality": quality.op4_quality,
    "op5_ngram_jaccard_join": near_dup.op5_ngram_jaccard_join,
    "op6_chat_format": chat.op6_chat_format,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_shard": sharding.op8_shard,
    "op9_language_id": langid.op9_language_id,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_search": search.op11_search,
    "op12_bpe": bpe.op12_bpe,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_search": search.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
