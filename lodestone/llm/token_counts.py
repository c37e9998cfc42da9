"""Operator 4: exact token counts of a corpus for every context limit.

Method: exact length histogram. Documents are summed by encoded length; suffix sums over the
lengths answer totals, quantiles and truncated totals at each limit. The sums run in blocks of
lengths, so no task holds all lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import texts
from .common import written
from .tokens import lengths

BLOCK = 256


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) over the ``text`` of ``docs``; null and empty texts have 0 tokens."""
    counted = docs.select("text").mapInArrow(lambda it: lengths(it, vocabulary), "n_tokens long")
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per length that occurs, read as a context limit: documents and tokens of that length, over it, and kept at it.

    Columns: ``context_limit``; ``n_docs`` of exactly that many tokens; ``docs_over`` longer
    ones; ``total_tokens`` of the corpus; ``kept_tokens`` when each document is cut at the
    limit; ``quantile`` the share of documents no longer than it. An empty table gives no rows;
    null text counts as 0 tokens; other columns are ignored.
    """
    # Read twice below; a row for each length that occurs, written so that texts are encoded once.
    h = written(length_histogram(docs, vocabulary), "lengths").withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    zero: Column = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(longer), zero).alias("docs_after"), F.coalesce(F.sum("bt").over(longer), zero).alias("tokens_after"), F.sum("bd").over(everywhere).alias("all_docs"), F.sum("bt").over(everywhere).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.sum("n_docs").over(inside), zero) + F.col("docs_after")
    tokens_over = F.coalesce(F.sum("tokens").over(inside), zero) + F.col("tokens_after")
    return h.join(blocks, "block").select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        over.alias("docs_over"),
        "total_tokens",
        (F.col("total_tokens") - tokens_over + over * F.col("n_tokens")).alias("kept_tokens"),
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("quantile"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(texts(spark, sf_dir))
