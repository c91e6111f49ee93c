"""The numbered queries over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import corpus_pipeline

from .common import table
from . import class_lm, collocations, conversations, decontaminate, fingerprints, language_id, line_dedup, mixing, simhash, substring_dedup, suffix_dedup, toxicity, url_filter

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


@_register("op7_line_dedup", line_dedup.ORACLE)
def op7(spark, sf_dir):
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


@_register("op1_document_fingerprints")
def op1(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@_register("op9_simhash_near_dedup")
def op9(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_register("op10_benchmark_decontamination")
def op10(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register("op3_mixing")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", *mixing.ADDED)


@_register("op6_language_id")
def op6(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


@_register("op5_toxicity")
def op5(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@_register("op2_url_filters")
def op2(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.labels_of(table(spark, sf_dir, "labels")))


@_register("op8_substring_dedup", substring_dedup.ORACLE)
def op8(spark, sf_dir):
    return substring_dedup.report(table(spark, sf_dir, "documents"))


@_register("op4_suffix_array_dedup", suffix_dedup.ORACLE)
def op4(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@_register("op11_phrase_collocations", collocations.ORACLE)
def op11(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@_register("op12_conversation_repair", conversations.ORACLE)
def op12(spark, sf_dir):
    return conversations.report(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@_register("op13_class_lm")
def op13(spark, sf_dir):
    return class_lm.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
