"""From raw documents to packed training sequences: each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import written
from lodestone.llm.language_id import identified
from lodestone.llm.mixing import mixed_texts
from lodestone.llm.near_dedup import deduplicated
from lodestone.llm.packing import pack_documents
from lodestone.llm.suffix_dedup import suffix_dedup
from lodestone.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that can be told; null ``lang`` is filled with it.

    Null, empty and letterless texts go; all others stay, whatever their language. Null and repeated doc_ids are rows like
    others; columns may bear any names; an empty table gives no rows.
    """
    ship(spark)
    return identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, null being the last.

    Rows are judged by their texts, so that rows of one doc_id with other texts stay and equal rows do not. Null and
    wordless texts stay; columns may bear any names; an empty table gives no rows.
    """
    ship(spark)
    return deduplicated(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what 50-byte strings of earlier documents cover; no document goes.

    Null texts stay null, short ones whole; a null doc_id is later than all others, and rows of one doc_id do not cut each
    other; ``n_chars`` is counted anew; columns may bear any names; an empty table gives no rows.
    """
    ship(spark)
    return suffix_dedup(docs, with_text=True).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, the last time perhaps in part.

    Null and wordless texts go, having nothing to take. A null source is one of its own; repeated rows are taken each;
    columns may bear any names; an empty table gives no rows.
    """
    ship(spark)
    return mixed_texts(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 4096 tokens, of repeated rows each.

    Null and empty texts are one token; null doc_ids stay null; other columns are not returned; an empty table gives no rows.
    """
    ship(spark)
    return pack_documents(docs)


STAGES = [("language ID", language_id), ("near-duplicate removal", near_dedup), ("suffix-array dedup", suffix_array_dedup), ("source mixing", mixing), ("best-fit packing", packing)]
#: Models, hashed draws and packing have no SQL; ``tests/llm/test_pipeline.py`` holds each stage against its plain definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
