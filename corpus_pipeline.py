"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next.

All stages but the last return the columns of ``documents``; the last places every piece of every text in a sequence.
Texts that are null, empty or without a letter go with the first stage; empty tables pass through every stage. Rows that repeat id and text are
one document to the duplicate stages: all of them stay or go. Very long texts are judged, compared and packed whole. Extra columns
are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitewarden.llm import exact_dedup, language_id, packing, secret_scan, simhash_dedup
from sitewarden.llm.common import ship_package, staged, table
from sitewarden.session import release_staged, staged_so_far


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus itself teaches; texts without letters and unlike any language go. Rows without id stay."""
    ship_package(spark)
    return language_id.keep_recognised(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; rows without id stay only where no equal text has one."""
    ship_package(spark)
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; a group without any id stays whole."""
    ship_package(spark)
    return simhash_dedup.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; credentials that look live are masked."""
    ship_package(spark)
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", recognised), ("exact_dedup", exact), ("simhash", near), ("secret_scan", secrets), ("pack", pack)]

#: Learned languages, XXH64 fingerprints and a tokenizer's ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = staged_so_far()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
            release_staged(spark, before)  # what earlier stages wrote is not read again
    return docs
