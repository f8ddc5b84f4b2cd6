"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from loomgene.llm import (
    bpe_table,
    edit_leaks,
    katz_model,
    license_rules,
    line_templates,
    parity_join,
    parse_language,
    repeat_trees,
    shuffle_shards,
    va_search,
)

QUERIES = {
    "op1_va_search": va_search.op1_va_search,
    "op2_parse_language": parse_language.op2_parse_language,
    "op3_license_rules": license_rules.op3_license_rules,
    "op4_katz_model": katz_model.op4_katz_model,
    "op5_parity_join": parity_join.op5_parity_join,
    "op6_line_templates": line_templates.op6_line_templates,
    "op7_shuffle_shards": shuffle_shards.op7_shuffle_shards,
    "op8_edit_leaks": edit_leaks.op8_edit_leaks,
    "op9_repeat_trees": repeat_trees.op9_repeat_trees,
    "op10_bpe_table": bpe_table.op10_bpe_table,
}

ORACLE_SQL = {
    "op1_va_search": va_search.OP1_SQL,
    "op3_license_rules": license_rules.OP3_SQL,
    "op9_repeat_trees": repeat_trees.OP9_SQL,
}
