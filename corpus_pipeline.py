"""A corpus pipeline of five stages: language identification, line deduplication, near duplicates, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. All but the last return
the columns of the documents table. Rows with null ids or texts go on like others: a null text has no language and is
dropped by the first stage; a null doc_id joins with nothing and is kept by the stages that go by ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspark.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from glyphspark.llm._spark import bounded_batches, documents, join_counted, remove_folder, shared_folder
from glyphspark.llm.queries import held_out, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Lines whose key this many documents hold stay in the first of them only.
COMMON_LINE_DOCS = 10


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told with a margin; ``lang`` stays as it came."""
    bounded_batches(spark)
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    return language_id.predict(docs.select(*COLUMNS), model, keep=COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share, but for the first of each; ``n_chars`` follows the text.

    Of a large group of copies the one with the smallest id keeps its text; the others lose theirs and stay as empty documents.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), min_docs=COMMON_LINE_DOCS, keep_first=True)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every component of similar documents."""
    bounded_batches(spark)
    found = ngram_join.ngram_components(docs.select("doc_id", "text"))
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return join_counted(docs.select(*COLUMNS), gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a passage with the benchmark."""
    bounded_batches(spark)
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    bounded_batches(spark)
    return bpe.bpe(docs.select("doc_id", "text"), tokenizer_path(), with_ids=True)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("encoded", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next.

    What a stage wrote goes when the next one has written; what the last stage reads stays, as the result is read from it.
    """
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    written = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if written:
                remove_folder(spark, written)
            written = f"{folder}/{k}-{name}"
    return docs
