"""Queries of this folder, by name, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from . import chat_perspectives, conversation_trie, embedding_forest, lexicon_bpe, ngram_join, packing, quality_ranking, quality_rules, secret_scans, spelling_groups, suffix_tree_lm, toxicity_grammar, url_aliases


def queries() -> dict:
    return {
        "op1_suffix_tree_lm": suffix_tree_lm.op1_suffix_tree_lm,
        "op2_secret_scans": secret_scans.op2_secret_scans,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_lexicon_bpe": lexicon_bpe.op4_lexicon_bpe,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_quality_ranking": quality_ranking.op6_quality_ranking,
        "op7_embedding_forest": embedding_forest.op7_embedding_forest,
        "op8_chat_perspectives": chat_perspectives.op8_chat_perspectives,
        "op9_url_aliases": url_aliases.op9_url_aliases,
        "op10_packing": packing.op10_packing,
        "op11_toxicity_grammar": toxicity_grammar.op11_toxicity_grammar,
        "op12_conversation_trie": conversation_trie.op12_conversation_trie,
        "op13_spelling_groups": spelling_groups.op13_spelling_groups,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE,
        "op8_chat_perspectives": chat_perspectives.ORACLE,
        "op9_url_aliases": url_aliases.ORACLE,
        "op12_conversation_trie": conversation_trie.ORACLE,
        "op13_spelling_groups": spelling_groups.ORACLE,
    }
