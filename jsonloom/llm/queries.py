"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from jsonloom.llm import chat, debruijn, decontaminate, flac, jaccard, language, packing, pii, sparse, urls
from jsonloom.llm.common import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.digests(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_sparse(spark, sf_dir):
    return sparse.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_chat(spark, sf_dir):
    return chat.digests(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))



def op2_flac(spark, sf_dir):
    return flac.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_language(spark, sf_dir):
    return language.digests(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_pii(spark, sf_dir):
    return pii.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_urls(spark, sf_dir):
    return urls.judged(table(spark, sf_dir, "pages", "page_id", "url"))


def op9_debruijn(spark, sf_dir):
    return debruijn.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_jaccard(spark, sf_dir):
    return jaccard.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_flac, op3_language, op4_sparse, op5_packing, op6_chat, op7_pii, op8_urls, op9_debruijn, op10_jaccard)}
ORACLES = {"op1_decontaminate": decontaminate.ORACLE, "op4_sparse": sparse.ORACLE, "op6_chat": chat.ORACLE, "op9_debruijn": debruijn.ORACLE, "op10_jaccard": jaccard.ORACLE}
