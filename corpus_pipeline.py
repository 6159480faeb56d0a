"""A training-data pipeline over ``documents``: each stage reads what the one before it has written.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``,
further columns of whatever names included. An empty table gives no rows; repeated rows are judged each, except
where the near-dedup stage keeps one of them; a row without a doc_id is a document like any other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import remove_folder, scratch, table

#: SQL cannot express the recurrent network, the packing or the template windows; the tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network has learned; null and empty texts, those without a letter, and those that it can't tell, go."""
    from tessera.llm.langid import keep_identified

    learnable = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1
    return keep_identified(docs, docs.where(learnable))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies; texts without a word are one group.

    Near copies have a five-word similarity of 0.8 or more, which the texts themselves are held to. Which texts are compared
    is found by eight families of fingerprints over shingles of two words, each with an index, where 4 bits may differ in one of them."""
    from tessera.llm.simhash import keep_one

    return keep_one(docs, width=5, similarity=0.8, radius=4, families=8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    from tessera.llm.decontaminate import without_contaminated

    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; null and empty texts stay as they are."""
    from tessera.llm.secrets import fit, redact

    return redact(docs, fit(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: the pieces of the documents with their tokens and places; a null or empty text is an end token."""
    from tessera.llm.packing import pack
    from tessera.llm.queries import tokenizer_path

    # the workers also keep what earlier stages have put in memory
    return pack(docs, tokenizer_path(), cache_words=100_000)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each but the last is written as Parquet in the shared folder and reread.

    What a stage has written goes once the next one has written its own."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
