"""Counts over chunks and file listings."""

from __future__ import annotations

import platform

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import suffix

MB = 1024 * 1024


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), sorted by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def dataset_summary(chunks: DataFrame, code: str = "code", docstring: str = "docstring") -> DataFrame:
    """One row: chunks, share with a docstring to 4 digits, mean characters of code to 2; 0 for an empty table."""
    n = F.count("*")
    covered = F.count_if(F.coalesce(F.col(docstring), F.lit("")) != "")
    return chunks.agg(
        n.alias("total_chunks"),
        F.when(n > 0, F.round(covered / n, 4)).otherwise(0.0).alias("docstring_coverage_ratio"),
        F.when(n > 0, F.round(F.avg(F.length(code)), 2)).otherwise(0.0).alias("average_code_length_chars"),
    )


def distributions(chunks: DataFrame, **by: Column) -> DataFrame:
    """(dimension, value, n) of several columns in one pass, by grouping sets."""
    names = list(by)
    cols = chunks.select(*(c.alias(n) for n, c in by.items()))
    sets = [[F.col(n)] for n in names]
    grouped = cols.groupingSets(sets, *map(F.col, names)).agg(F.count("*").alias("n"), *(F.grouping(n).alias(f"g_{n}") for n in names))
    dimension = value = None
    for n in names:
        here = F.col(f"g_{n}") == 0
        dimension = (F.when if dimension is None else dimension.when)(here, n)
        value = (F.when if value is None else value.when)(here, F.col(n).cast("string"))
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n")


def dataset_stats(chunks: DataFrame) -> DataFrame:
    """(dimension, value, n) of chunk types, languages and symbol types that are not empty."""
    symbol = F.col("ast.symbol_type")
    return distributions(chunks, chunk_type=F.col("chunk_type"), language=F.col("language"), symbol_type=symbol).where("dimension <> 'symbol_type' or coalesce(value, '') <> ''")


def repo_stats(chunks: DataFrame) -> DataFrame:
    """(dimension, value, n) of file suffixes, chunk types and languages."""
    return distributions(chunks, file_type=suffix(F.col("file_path")), chunk_type=F.col("chunk_type"), language=F.col("language"))


def dataset_metadata(chunks: DataFrame, name: str, version: str) -> DataFrame:
    """One row: name, version, sorted languages, distinct files, chunks, and when and by what Python it was made."""
    return chunks.agg(F.array_sort(F.collect_set("language")).alias("languages"), F.count_distinct("file_path").alias("total_files"), F.count("*").alias("total_chunks")).select(
        F.lit(name).alias("dataset_name"),
        F.lit(version).alias("dataset_version"),
        F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("created_at"),
        F.lit("hierarchical_ast").alias("chunking_strategy"),
        "languages",
        F.lit(platform.python_version()).alias("python_version"),
        "total_files",
        "total_chunks",
    )


def listing_stats(files: DataFrame) -> DataFrame:
    """One row: files, bytes, text and binary files of ``files(size, is_binary)``."""
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.count_if(F.col("is_binary")).alias("binary_files"), F.count_if(~F.col("is_binary")).alias("text_files"))


def tree_stats(files: DataFrame) -> DataFrame:
    """One row: files, MB and the first 20 suffixes by name, of ``files(relative_path, size, extension)`` outside ``.git``."""
    some = files.where(~F.array_contains(F.split("relative_path", "/"), ".git"))
    found = F.array_sort(F.collect_set(F.when(F.col("extension") != "", F.col("extension"))))
    return some.agg(F.count("*").alias("total_files"), F.round(F.coalesce(F.sum("size"), F.lit(0)) / MB, 2).alias("total_size_mb"), F.slice(found, 1, 20).alias("unique_extensions"))


def top_suffixes(files: DataFrame, k: int = 10) -> DataFrame:
    """(extension, n) of the k most frequent suffixes, ties by suffix; ``.git`` counts here."""
    return files.groupBy("extension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").limit(k)


def repo_size(files: DataFrame) -> DataFrame:
    """One row: MB of all files, and the number of those whose path holds no ``.git``."""
    return files.agg(F.round(F.coalesce(F.sum("size"), F.lit(0)) / MB, 2).alias("size_mb"), F.count_if(~F.col("path").contains(".git")).alias("file_count"))


def row_mean(*columns: str) -> Column:
    """Mean of the columns that are not null."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))
