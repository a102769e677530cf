"""Registered queries of the corpus operators, each over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyfence.llm import bpe, collocations, deleted_interpolation, edit_fingerprints, html_text, jaccard_join, language_id, mixing, quality_model, quality_rules, spelling, token_counts, warc
from skyfence.llm.common import table
from skyfence.session import shared_dir


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score_documents(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit_on_sample(docs, table(spark, sf_dir, "labels")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    return warc.page_records(warc.read_archives(spark, path), pages.schema["page_id"].dataType)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_deleted_interpolation, op2_html_text, op3_mix_sources, op4_jaccard_join, op5_byte_bpe, op6_quality_classifier, op7_edit_fingerprints, op8_language_id, op9_token_counts, op10_quality_rules, op11_collocations, op12_warc, op13_spelling)}

ORACLES = {
    "op3_mix_sources": f"select doc_id, size, source_size, target, epochs * size as taken from ({mixing.MIX_SQL.format(docs='documents')})",
    "op11_collocations": collocations.COLLOCATIONS_SQL.format(docs="documents"),
    "op12_warc": warc.RECORDS_SQL.format(pages="pages"),
}
