"""Queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from corpusloom.llm import bpe, chat_format, langid, license_scan, ngram_join, packing, quality, topk, url_filter, warc

QUERIES = {
    "op10_ngram_jaccard": ngram_join.op10_ngram_jaccard,
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_warc": warc.op4_warc,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_bpe_codec": bpe.op6_bpe_codec,
    "op7_language_id": langid.op7_language_id,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_license_scan": license_scan.op9_license_scan,
}

SQL = {
    "op10_ngram_jaccard": ngram_join.OP10_SQL,
    "op2_chat_format": chat_format.OP2_SQL,
    "op3_url_filter": url_filter.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op8_exact_topk": topk.OP8_SQL,
    "op9_license_scan": license_scan.OP9_SQL,
}
