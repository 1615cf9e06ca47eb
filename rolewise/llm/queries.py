"""Queries of this subpackage and the SQL twins of those that SQL can say."""

from __future__ import annotations

from rolewise.llm import chat, codes, decontamination, language, lexical, lines, mixing, private, quality, scoring, simhash, tokens, warc
from rolewise.llm.common import Query

QUERIES: dict[str, Query] = {
    "op1_cgk_decontamination": decontamination.op1_cgk_decontamination,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_maxent_scoring": scoring.op3_maxent_scoring,
    "op4_revisit_resolution": warc.op4_revisit_resolution,
    "op5_line_winnowing": lines.op5_line_winnowing,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_rule_ledger": quality.op7_rule_ledger,
    "op8_skip_chain_pii": private.op8_skip_chain_pii,
    "op9_compression_language": language.op9_compression_language,
    "op10_simhash_blocks": simhash.op10_simhash_blocks,
    "op11_prefix_examples": chat.op11_prefix_examples,
    "op12_dual_tree_search": lexical.op12_dual_tree_search,
    "op13_trie_codes": codes.op13_trie_codes,
}
ORACLES: dict[str, str] = {
    "op4_revisit_resolution": warc.OP4_SQL,
    "op5_line_winnowing": lines.OP5_SQL,
    "op6_source_mixing": mixing.OP6_SQL,
    "op7_rule_ledger": quality.OP7_SQL,
    "op11_prefix_examples": chat.OP11_SQL,
    "op12_dual_tree_search": lexical.OP12_SQL,
    "op13_trie_codes": codes.OP13_SQL,
}
