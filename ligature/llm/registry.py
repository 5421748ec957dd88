"""Queries of this subpackage, by name, and the SQL of those that SQL can state."""

from __future__ import annotations

from ligature.llm import bpe, chat, decontaminate, exact_dedup, html_main, licences, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_html_main": html_main.op3_html_main,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_toxicity": toxicity.op5_toxicity,
    "op9_chat_format": chat.op9_chat_format,
    "op10_warc": warc.op10_warc,
    "op6_license_scan": licences.op6_license_scan,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_simhash": simhash.op8_simhash,
}

ORACLE = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op10_warc": warc.ORACLE,
}
