"""The corpus pipeline: toxicity, language, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages the
rows are written as Parquet to the shared folder and read again. All but the last return the columns
of ``documents``.

* toxicity: the classifier chain, fitted on the labelled rows of the documents at hand; documents at
  or over its threshold go.
* language: the language filters, learned from the documents' own lang column; documents without a
  letter go, and long enough ones almost none of whose n-grams any language has.
* near_dedup: five-word shingles, similarity 0.8; of each group the smallest id stays.
* decontaminate: documents that hold half of a benchmark item or more go.
* pack: windows of 2048 ids; the pieces.

Null or empty texts are not toxic, have no language and go at the second stage. Rows that repeat an id
leave one at the third. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.common import fresh_path
from fathomline.llm.decontaminate import clean
from fathomline.llm.language_id import keep_known
from fathomline.llm.language_id import train as train_languages
from fathomline.llm.near_dedup import keep_one
from fathomline.llm.packing import pack
from fathomline.llm.queries import CHAIN
from fathomline.llm.toxicity_chain import keep_clean
from fathomline.llm.toxicity_chain import train as train_toxicity

#: Neither stage can be put as SQL: they fit models.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CHAIN))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs, train_languages(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # small batches: the workers still hold what the stages before have loaded
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), batch_bytes=1_000_000)


STAGES = [("toxicity", toxicity), ("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
