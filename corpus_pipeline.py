"""Documents to token counts in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyfence.llm import bpe, jaccard_join, mixing, quality_model, quality_rules
from skyfence.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more stay."""
    return quality_model.accepted_documents(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep stay. The model learns from labelled rows of the whole table, as its input has lost the bad ones."""
    model = quality_rules.fit_on_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.kept_documents(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles, that with the smallest id stays."""
    return jaccard_join.one_of_each(docs, size=5, per_cent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document taken. Few remembered pieces, as the executors' heaps have grown in the stages before."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False, memo=50_000)


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("n-gram Jaccard join", one_of_each_group), ("mixing sources", mix), ("byte-level BPE", encode)]

#: The trained stages and the encoding are beyond SQL.
ORACLE_SQL = None


#: Rows that Spark hands to a Python worker of the encoding at once (10,000 unless set): their texts wait in both processes.
BATCH_ROWS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with small_batches(spark) if stage is encode else nullcontext():
            docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
