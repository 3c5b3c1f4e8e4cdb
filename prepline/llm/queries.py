"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from prepline.llm import ann, bpe, chat, html_extract, line_dedup, merkle, minhash, mixing, packing, quality_classifier, quality_rules, repair, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_minhash_near_dedup": minhash.op8_minhash_near_dedup,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_ann": ann.op10_ann,
    "op11_bpe": bpe.op11_bpe,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
