"""Prefix doubling written plainly in DataFrame operations: what op1's method must agree with, and what its figures are held against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.suffix_dedup import suffix_dedup

SF = "/root/testdata/sf0.001"


def doubling(docs: DataFrame, length: int = 50, first: int = 8) -> DataFrame:
    """(doc_id, at) of each byte position whose next ``length`` bytes also start in a document with a smaller doc_id.

    Ranks by the first ``first`` bytes come first, then ranks of the pairs (rank at a position, rank at an offset from it),
    at offsets that double up to ``length``. A rank is the smallest position that has it. Positions whose rank only one
    document has leave after each sort. doc_ids must be distinct and between 0 and 2^31.
    """
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).where(F.octet_length("raw") >= length)
    starts = raw.select("doc_id", "raw", F.explode(F.sequence(F.lit(0), F.octet_length("raw") - first)).alias("at"))
    keyed = starts.select((F.shiftleft("doc_id", 32) + F.col("at")).alias("pos"), F.col("raw").substr(F.col("at") + 1, F.lit(first)).alias("name"))

    def ranked(rows: DataFrame, *names: str) -> DataFrame:
        same = Window.partitionBy(*names)
        least, most = F.min("pos").over(same), F.max("pos").over(same)
        told = rows.select("pos", least.alias("rank"), most.alias("most"))
        return told.where(F.shiftright("rank", 32) < F.shiftright("most", 32)).select("pos", "rank")

    size, ranks = first, ranked(keyed, "name")
    while size < length:
        step = min(size, length - size)
        after = ranks.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        ranks = ranked(ranks.join(after, "pos"), "rank", "next")
        size += step
    later = ranks.where(F.shiftright("rank", 32) < F.shiftright("pos", 32))
    return later.select(F.shiftright("pos", 32).alias("doc_id"), F.col("pos").bitwiseAND(F.lit((1 << 32) - 1)).alias("at"))


def removed(spans: DataFrame, length: int) -> dict[int, int]:
    """Bytes of each document that strings of ``length`` from its positions cover."""
    out = {}
    for doc, places in spans.groupBy("doc_id").agg(F.sort_array(F.collect_list("at")).alias("at")).collect():
        at = np.array(places)
        out[doc] = int(length + np.minimum(np.diff(at), length).sum())
    return out


def test_method_agrees_with_doubling(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for first in (8, 25):
        want = removed(doubling(docs, 50, first), 50)
        got = {r.doc_id: r.n_removed for r in suffix_dedup(docs).collect()}
        assert want and {d: n for d, n in got.items() if n} == want


def test_lengths_that_doubling_does_not_meet(spark):
    docs = spark.createDataFrame([(1, "the same passage twice, é and more"), (2, "x the same passage twice, é and less"), (3, None), (4, ""), (5, "short"), (6, "the same passage")], "doc_id long, text string")
    for length, k in ((13, 5), (20, 7), (31, 30)):
        got = {r.doc_id: r.n_removed for r in suffix_dedup(docs, length=length, k=k).collect() if r.n_removed}
        assert got == removed(doubling(docs, length, 4), length)
